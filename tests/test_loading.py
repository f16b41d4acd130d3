"""Files to chunks: cache, failing pages and files, pictures."""

from docengine.plans import loading, store

FILE = "path string, content binary"
LONG = "a text that is long enough to be a chunk"


def stubs():
    """Functions that tasks get by value, as they can't import tests."""
    long = LONG

    def read(content):
        said = content.decode()
        if said == "broken":
            raise ValueError("no PDF")
        yield {"page": 1, "markdown": f"{long} of {said}", "visual": True, "image_path": f"{said}.png"}
        yield {"page": 2, "error": "ValueError: torn"} if said == "torn" else {"page": 2, "plain": f"{long} again", "visual": True}

    def see(image):
        if image == "dark.png":
            raise ValueError("cannot see")
        return f"a picture of {image} with a box and an arrow"

    def never(content):
        raise AssertionError("read again")

    return read, see, never


def files(spark, **contents):
    return spark.createDataFrame([(f"/d/{k}.pdf", None if v is None else bytearray(v.encode())) for k, v in contents.items()], FILE)


def chunks(loaded):
    return sorted((r.path, r.chunk_index, r.page, r.method) for r in loaded.chunks.collect())


def test_cache_is_asked_first_and_knows_only_whole_files(spark, tmp_path):
    read, see, never = stubs()
    cache = f"file://{tmp_path}/cache"
    given = {"good": "good", "torn": "torn", "broken": "broken", "dark": "dark", "none": None}
    first = loading.load(files(spark, **given), read, cache, see, buckets=2)
    want = [("/d/dark.pdf", 0, 1, "markdown"), ("/d/dark.pdf", 1, 2, "plain_text"), ("/d/good.pdf", 0, 1, "markdown"), ("/d/good.pdf", 1, 2, "plain_text"), ("/d/good.pdf", 2, 1, "vlm"), ("/d/torn.pdf", 0, 1, "markdown"), ("/d/torn.pdf", 1, 1, "vlm")]
    assert chunks(first) == want and first.cached.count() == 0
    errors = {r.file_key: r.message for r in first.errors.collect()}
    assert errors.pop("file_none_pdf").startswith("AttributeError")
    assert errors == {"file_torn_pdf": "page 2: ValueError: torn", "file_broken_pdf": "ValueError: no PDF", "file_dark_pdf": "ValueError: cannot see"}

    second = loading.load(files(spark, good="good", dark="dark"), never, cache, see, buckets=2)
    assert chunks(second) == [w for w in want if "good" in w[0]]
    assert [r.path for r in second.cached.collect()] == ["/d/good.pdf"] and [r.file_key for r in second.errors.collect()] == ["file_dark_pdf"]

    changed = loading.load(files(spark, good="other", torn="torn"), read, cache, buckets=2)
    assert changed.cached.count() == 0 and sorted(r.text for r in changed.chunks.where("page = 1").collect()) == [f"{LONG} of other", f"{LONG} of torn"]
    kept = store.read(spark, cache).where("path = '/d/good.pdf' and page = 1").collect()
    assert [r.text for r in kept] == [f"{LONG} of other"]


def test_no_files_and_a_folder(spark, tmp_path):
    read, see, _ = stubs()
    empty = loading.load(spark.createDataFrame([], FILE), read, f"file://{tmp_path}/cache", see, buckets=2)
    assert empty.chunks.count() == empty.errors.count() == empty.cached.count() == 0
    (tmp_path / "a").mkdir()
    for name in ("a/one.PDF", "a/two.txt"):
        (tmp_path / name).write_text("torn")
    out = loading.load_folder(spark, f"file://{tmp_path}/a", read)
    assert [(r.source, r.page) for r in out.chunks.collect()] == [("one.PDF", 1)] and [r.message for r in out.errors.collect()] == ["page 2: ValueError: torn"]
