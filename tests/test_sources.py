"""Files, images, and the audits that SQL does not express."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curalith.operators import audit, images, manifest
from curalith.sources import files


def png(path, pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[i].tobytes() for i in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 255, (8, 8, 3))
    picture = np.kron(base, np.ones((8, 8, 1))).astype(np.uint8)
    for name in ("b class", "Alpha"):
        (tmp_path / "root" / name / "deep").mkdir(parents=True)
    png(tmp_path / "root/b class/one.PNG", picture)
    png(tmp_path / "root/b class/deep/mirror.png", picture[:, ::-1].copy())
    png(tmp_path / "root/Alpha/black.png", np.zeros((40, 40, 3), np.uint8))
    png(tmp_path / "root/Alpha/small.png", picture[:16, :16].copy())
    (tmp_path / "root/Alpha/broken.png").write_bytes(b"no image")
    (tmp_path / "root/Alpha/notes.txt").write_text("x")
    (tmp_path / "root/AA empty").mkdir()
    (tmp_path / "root/b class/root").mkdir()
    png(tmp_path / "root/b class/root/two.png", picture.swapaxes(0, 1).copy())
    (tmp_path / "root/b class/three.TIFF").write_bytes(b"no image")
    return str(tmp_path / "root")


def test_labelled_files(spark, folder):
    got = {r.name: r for r in files.with_digests(files.labelled_files(spark, folder, {"alpha": "Zeta", "b_class": "Beta"}, content=True)).collect()}
    assert len(got) == 8 and not got["notes.txt"].kept and got["notes.txt"].label is None and got["three.TIFF"].kept
    # a folder without files counts, and a folder with the root's name does not hide the class
    assert (got["one.PNG"]["class"], got["one.PNG"].label, got["black.png"].label, got["two.png"]["class"]) == ("Beta", 1, 2, "Beta")
    assert got["mirror.png"].relative_path == "b class/deep/mirror.png" and got["two.png"].relative_path == "b class/root/two.png" and len(got["mirror.png"].sha256) == 64
    with pytest.raises(ValueError, match="one class"):
        files.labelled_files(spark, folder, {"alpha": "B", "b_class": "B"})


def test_root_is_found_by_its_folders(spark, tmp_path):
    for name in ("deep/er/A", "deep/er/B", "other/A", "other/B", "other/C"):
        (tmp_path / name).mkdir(parents=True)
    assert files.find_root(spark, str(tmp_path), {"A", "B"}) == f"{tmp_path}/deep/er"
    assert files.find_root(spark, str(tmp_path), {"A", "B", "C"}, ("other",)) == f"{tmp_path}/other"
    with pytest.raises(FileNotFoundError):
        files.find_root(spark, str(tmp_path), {"A", "X"})


def test_images(spark, folder):
    rows = {r.path.rsplit("/", 1)[-1]: r for r in images.with_statistics(images.with_orientation(images.read_images(spark, folder), folder)).withColumn("bad", images.degenerate()).collect()}
    assert rows["one.PNG"].valid and not rows["small.png"].valid and not rows["broken.png"].valid and rows["broken.png"].hash is None
    assert rows["black.png"].bad and not rows["one.PNG"].bad and rows["black.png"].dark_share == 1.0 and len(rows["one.PNG"].border_mean) == 3
    a, b = rows["one.PNG"].hash, rows["mirror.png"].hash
    assert ((a[1] ^ b[0]) & (2**64 - 1)).bit_count() <= 2 and ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() > 10
    ring = {r.path.rsplit("/", 1)[-1]: r.pixels for r in images.border_pixels(images.read_images(spark, folder)).collect()}
    assert len(ring["one.PNG"]) == 3 * (48 * 48 - 32 * 32) and "broken.png" not in ring


def test_inventory(spark, folder):
    found = files.with_digests(files.labelled_files(spark, folder, content=True)).drop("content")
    stats = images.with_statistics(images.read_images(spark, folder)).withColumn("name", F.element_at(F.split(F.url_decode("path"), "/"), -1))
    ok, invalid, odd = images.inventory(found, stats, manifest.suspicious(F.col("name"), F.col("class"), {"b class": ["mirr"]}))
    assert {r.name for r in ok.collect()} == {"one.PNG", "mirror.png", "two.png"}
    assert {r.relative_path: r.reason for r in invalid.collect()} == {"Alpha/black.png": "blank or black", "Alpha/small.png": "too small", "Alpha/broken.png": "does not decode", "b class/three.TIFF": "does not decode"}
    assert [tuple(r) for r in odd.collect()] == [("b class/deep/mirror.png", "b class", "mirr")]


def test_turned_and_fitted_pictures():
    a = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    entry = lambda n, end: b"Exif\0\0" + (b"II*\0" if end == "little" else b"MM\0*") + (8).to_bytes(4, end) + (1).to_bytes(2, end) + (0x112).to_bytes(2, end) + (3).to_bytes(2, end) + (1).to_bytes(4, end) + n.to_bytes(2, end) + b"\0" * 6
    for end in ("little", "big"):
        for n in range(1, 9):
            part = entry(n, end)
            assert images.exif_orientation(b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + (len(part) + 2).to_bytes(2, "big") + part) == n
    assert images.exif_orientation(b"\x89PNG") == 1 and images.exif_orientation(b"\xff\xd8\xff") == 1
    undo = {1: lambda x: x, 2: lambda x: x[:, ::-1], 3: lambda x: x[::-1, ::-1], 4: lambda x: x[::-1], 5: lambda x: x.swapaxes(0, 1), 6: lambda x: np.rot90(x), 7: lambda x: x[::-1, ::-1].swapaxes(0, 1), 8: lambda x: np.rot90(x, 3)}
    for n, turned in undo.items():
        assert (images.upright(turned(a), n) == a).all(), n
    box = images.fitted(a, 6, 127)
    assert box.shape == (6, 6, 3) and (box[0] == 127).all() and (box[5] == 127).all() and not (box[1:5] == 127).all()
    assert images.fitted(a, 6).shape == (6, 6, 3) and images.fitted(a[:1, :1], 4).shape == (4, 4, 3)
    flat = np.full((100, 70), 9.0)
    assert (images.resized(flat, 32) == 9).all()


def test_zip_cache_and_artifacts(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m/t.csv", 'id,extra,text\r\n1,x,"two\nlines, é"\r\n2,,\r\n')
    got = files.read_csv_in_zip(spark, str(tmp_path / "a.zip"), "m/t.csv", "id long, text string").collect()
    assert [tuple(r) for r in got] == [(1, "two\nlines, é"), (2, None)]
    with pytest.raises(Exception, match="lacks"):
        files.read_csv_in_zip(spark, str(tmp_path / "a.zip"), "m/t.csv", "id long, gone string").collect()
    rows, schema, path = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "sha string, v array<double>"), "sha string, v array<double>", str(tmp_path / "cache")
    wanted = spark.createDataFrame([("b",), ("a",)], "sha string")
    assert files.read_cache(spark, path, wanted, "sha", schema) is None
    files.write_cache(rows.where("sha = 'a'"), path, "sha")
    assert files.read_cache(spark, path, wanted, "sha", schema) is None
    files.write_cache(rows, path, "sha")
    assert sorted(files.read_cache(spark, path, wanted, "sha", schema).collect()) == sorted(rows.collect())
    files.write_crosstab(spark.createDataFrame([(2, "b"), (1, "a")], "n int, class string"), str(tmp_path / "tab"), "class")
    assert next((tmp_path / "tab").glob("*.csv")).read_text().split() == ["class,n", "a,1", "b,2"]
    (tmp_path / "private").mkdir()
    (tmp_path / "private" / "p.png").write_text("x")
    seen = {r.relative_path: r.public for r in files.artifacts(spark, str(tmp_path), ["a.zip"], ("private",), strict=True).collect()}
    assert seen["a.zip"] and not seen["private/p.png"]
    with pytest.raises(FileNotFoundError, match="gone.json"):
        files.artifacts(spark, str(tmp_path), ["gone.json"], strict=True)


def test_settings_and_log(tmp_path):
    from curalith import config

    s = config.settings(["--seed", "7", "--no-strict"], {"CURALITH_SEED": "5", "CURALITH_TAU_START": "0.8", "CURALITH_AUTO_RESOLVE": "false"})
    assert (s.seed, s.tau_start, s.strict, s.auto_resolve, s.tries) == (7, 0.8, False, False, 200)
    with pytest.raises(ValueError):
        config.settings(["--real-fraction", "0"], {})
    for _ in range(2):
        log = config.log_to(str(tmp_path / "run.log"))
    log.info("once")
    assert (tmp_path / "run.log").read_text().count("once") == 1


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", line\nand more'), (2, None)], "id long, text string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(files.read_csv(spark, str(tmp_path / "c"), df.schema).collect()) == sorted(df.collect())
    files.append_jsonl(df, str(tmp_path / "j"))
    files.append_jsonl(df, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), df.schema).count() == 4
    (tmp_path / "p.txt").write_text(" one \n\n  \ntwo\r\n")
    assert [tuple(r) for r in files.read_lines(spark, str(tmp_path / "p.txt")).orderBy("id").collect()] == [(1, "one"), (2, "two")]
    assert '"n": 2' in files.report_json(df.agg(F.count("*").alias("n")))
    got = {r.relative_path: (r.expected, r.present) for r in files.artifacts(spark, str(tmp_path), ["p.txt", "gone.csv"]).collect()}
    assert got["p.txt"] == (True, True) and got["gone.csv"] == (True, False)


def test_frechet(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(80, 4)), rng.normal(1, 2, size=(60, 4))
    rows = lambda v: spark.createDataFrame([("a", r.tolist()) for r in v] + [("lone", v[0].tolist())], "c string, v array<double>")
    got = audit.frechet(rows(x), rows(y), "c", "v").collect()
    s, t = np.cov(x.T), np.cov(y.T)
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(s + t) - 2 * np.sqrt(np.linalg.eigvals(s @ t).real).sum()
    assert len(got) == 1 and (got[0].n_a, got[0].n_b) == (80, 60) and abs(got[0].distance - want) < 1e-6


def test_shortcut_control(spark):
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.rand(1) / 2).alias("tell"), F.rand(2).alias("noise"))
    seen = lambda f: audit.shortcut_control(rows, f, "y", F.col("id") % 5 == 0).first()
    assert seen(["tell"]).balanced_accuracy > 0.95 and abs(seen(["noise"]).balanced_accuracy - 0.5) < 0.25


def test_orientation_behind_long_segments():
    """Headers far into a file count: nothing is read by a fixed number of bytes."""
    tiff = b"Exif\0\0MM\0*" + (8).to_bytes(4, "big") + (1).to_bytes(2, "big") + (0x112).to_bytes(2, "big") + (3).to_bytes(2, "big") + (1).to_bytes(4, "big") + (6).to_bytes(2, "big") + b"\0" * 6
    segment = lambda kind, part: b"\xff" + kind + (len(part) + 2).to_bytes(2, "big") + part
    data = b"\xff\xd8" + segment(b"\xe2", b"\0" * 65000) * 5 + segment(b"\xe1", tiff) + b"\xff\xda"
    assert data.index(b"Exif") > 1 << 17 and images.exif_orientation(data) == 6


def test_orientation_of_a_file_is_read_whole(spark, tmp_path):
    tiff = b"Exif\0\0II*\0" + (8).to_bytes(4, "little") + (1).to_bytes(2, "little") + (0x112).to_bytes(2, "little") + (3).to_bytes(2, "little") + (1).to_bytes(4, "little") + (8).to_bytes(2, "little") + b"\0" * 6
    segment = lambda kind, part: b"\xff" + kind + (len(part) + 2).to_bytes(2, "big") + part
    (tmp_path / "far.jpg").write_bytes(b"\xff\xd8" + segment(b"\xe2", b"\0" * 65000) * 3 + segment(b"\xe1", tiff) + b"\xff\xda")
    got = images.with_orientation(images.read_images(spark, str(tmp_path)), str(tmp_path)).select("orientation", "valid").collect()
    assert [tuple(r) for r in got] == [(8, False)]


def test_perceptual_hash_from_its_definition():
    """Cosines summed one by one over a picture that needs no resampling; bits above the median, rows first."""
    import math

    rng = np.random.default_rng(5)
    grey = rng.integers(0, 256, (32, 32)).astype(np.uint8)

    def by_hand(a):
        cos = [[math.cos(math.pi * (n + 0.5) * k / 32) for n in range(32)] for k in range(8)]
        c = [[sum(int(a[y, x]) * cos[v][y] * cos[u][x] for y in range(32) for x in range(32)) for u in range(8)] for v in range(8)]
        flat = [x for row in c for x in row]
        middle = sum(sorted(flat)[31:33]) / 2
        return int("".join("1" if x > middle else "0" for x in flat), 2)

    unsigned = [h & (1 << 64) - 1 for h in images.perceptual_hashes(grey)]
    assert unsigned == [by_hand(grey), by_hand(grey[:, ::-1]), by_hand(grey[::-1]), by_hand(grey[::-1, ::-1])]
