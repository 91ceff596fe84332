import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright import storage
from framewright.__main__ import main
from framewright.graph import connected_components
from framewright.models.codec import decode_png, encode_png, resize
from framewright.nodes import From, Load, Save, Workspace
from framewright.similarity import plan, vector_classes
from framewright.sources.downloads import DownloadCache
from framewright.sources.images import read_header
from framewright.sources.memo import MemoStore
from framewright.sources.objects import ObjectStore
from framewright.sources.save import clusters_page, index_html
from framewright.streaming.ingest import ingest


def test_memo_last_write_wins(spark, tmp_path):
    m = MemoStore(spark, str(tmp_path / "m"))
    assert m.get("f(1)") is None and m.count() == 0 and not m.drop()
    m.put_one("f(1)", "a")
    m.put_one("f(1)", "b")
    m.put_one("f(1)", "c", "d")
    m.put_one("g(1)", None)
    assert m.get("f(1)", "d") == "c" and m.get("f(1)") == "c" and m.count() == 3
    assert m.has("g(1)") and m.get("g(1)") is None and not m.has("h")
    assert m.count("f*") == 2 and m.count("[g]*") == 1 and m.count("f*", "d") == 1
    m.compact()
    other = MemoStore(spark, str(tmp_path / "o"))
    assert other.import_from(m, "f*") == 2 and other.count() == 2
    assert m.clear("f*", "d") == 1 and m.count() == 2 and m.clear("zz") == 0
    assert m.drop() and m.count() == 0


def test_fill_asks_once(spark, images, tmp_path):
    m, asked = MemoStore(spark, str(tmp_path / "m")), spark.sparkContext.accumulator(0)

    def work(rows):
        def f(frames):
            for p in frames:
                asked.add(len(p))
                yield p.assign(value=p["_key"].where(p["_key"] != "k2"))[["_key", "value"]]

        return rows.select("_key").mapInPandas(f, "_key string, value string")

    key = F.concat(F.lit("k"), (F.col("_pos") % 5).cast("string"))
    first = m.fill(images, key, work, "v").orderBy("_pos").collect()
    assert asked.value == 5 and [r.v for r in first] == [None if k % 5 == 2 else f"k{k % 5}" for k in range(10)]
    assert m.fill(images, key, work, "v").orderBy("_pos").collect() == first and asked.value == 5


def test_objects(spark, workspace):
    rows = spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "content binary")
    workspace.objects.put(rows)
    named = workspace.objects.put(rows)
    assert workspace.objects.objects().count() == 2
    assert workspace.objects.get(named.select("objectid")).filter("content is null").count() == 0


def picture(w, h, c=3, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)


def test_png():
    for c in (1, 2, 3, 4):
        p = picture(7, 5, c)
        raw = encode_png(p)
        assert (decode_png(raw) == p).all() and read_header(raw) == (7, 5, "PNG")
    assert resize(picture(40, 20), 10, 5).shape == (5, 10, 3) and (resize(picture(6, 6), 6, 6) == picture(6, 6)).all()


def test_headers():
    assert read_header(b"GIF89a" + bytes([2, 0, 3, 0])) == (2, 3, "GIF")
    assert read_header(b"RIFF0000WEBPVP8X" + bytes(8) + bytes([9, 0, 0, 4, 0, 0])) == (10, 5, "WEBP")
    assert read_header(b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x02\x00\x03\x01") == (3, 2, "JPEG")
    for bad in (None, b"", b"text", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"):
        assert read_header(bad) is None


def test_load_and_save(spark, tmp_path):
    src = tmp_path / "in" / "deep"
    src.mkdir(parents=True)
    (src / "a.PNG").write_bytes(encode_png(picture(8, 4)))
    (src / "b.png").write_bytes(encode_png(picture(8, 4)))
    (src / "bad.jpg").write_bytes(b"no picture")
    (src / "c.jpeg").write_bytes(b"not looked at")
    with Workspace(spark, str(tmp_path / "w")) as w:
        Load(str(tmp_path / "in")) >> Save()
        rows = w.run()[0].orderBy("_pos").collect()
    assert [(Path(r.original_path).name, r.ext, r.width, r.height, r.format) for r in rows] == [("a.PNG", ".PNG", 8, 4, "PNG"), ("b.png", ".png", 8, 4, "PNG")]
    out = {p.name for p in (tmp_path / "w" / "output").iterdir() if not p.name.startswith(".")}
    assert out == {f"a_{rows[0].objectid}.PNG", f"a_{rows[0].objectid}.json", f"b_{rows[1].objectid}.png", f"b_{rows[1].objectid}.json", "index.html"}
    assert json.loads((tmp_path / "w" / "output" / f"a_{rows[0].objectid}.json").read_text())["width"] == 8


def test_save_numbers_repeats_and_writes_captions(spark, tmp_path, images):
    same = images.withColumn("objectid", F.lit("x")).withColumn("original_path", F.lit("/nowhere/p.png"))
    with Workspace(spark, str(tmp_path / "w")) as w:
        From(same) >> Save("o", sidecars=False, index=False)
        w.run()
    out = sorted(p.name for p in (tmp_path / "w" / "o").glob("*.txt"))
    assert out == sorted(["p_x.txt"] + [f"p_x_{k}.txt" for k in (1, 2, 5, 6, 7, 8, 9)])  # null and empty captions write none


def test_save_without_the_images(spark, tmp_path, images, caplog):
    """Paths that can't be asked for are as those of no file: one with too long a name, and one in a folder that only others may enter."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p0.png").write_bytes(b"picture")
    (tmp_path / "shut").mkdir(mode=0)
    folder = F.when(F.col("_pos") == 0, f"{tmp_path}/in").when(F.col("_pos") == 1, f"{tmp_path}/{'x' * 300}").otherwise(f"{tmp_path}/shut")
    moved = images.withColumn("original_path", F.concat(folder, F.regexp_extract("original_path", "/[^/]*$", 0)))
    with Workspace(spark, str(tmp_path / "w")) as w:
        From(moved) >> Save("o", index=False)
        w.run()
    out = [p.name for p in (tmp_path / "w" / "o").iterdir() if not p.name.startswith(".")]
    assert sum(x.endswith(".txt") for x in out) == 8 and sum(x.endswith(".json") for x in out) == 10
    assert [x for x in out if x.endswith(".png")] == [f"p0_{0:064x}.png"]
    assert "9 images are neither" in caplog.text


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.png").write_bytes(encode_png(picture(8, 4)))
    (src / "b.png").write_bytes(encode_png(picture(8, 4)))
    args = spark, str(src), str(tmp_path / "t"), str(tmp_path / "c")
    ingest(*args)
    (src / "c.png").write_bytes(encode_png(picture(3, 2)))
    ingest(*args)
    assert sorted((r.width, r.height) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(3, 2), (8, 4)]


def test_load_reads_only_new_files(spark, tmp_path):
    src = tmp_path / "in [1]"
    src.mkdir()
    (src / "a b.png").write_bytes(encode_png(picture(8, 4)))
    (src / "bad.png").write_bytes(b"no picture")
    with Workspace(spark, str(tmp_path / "w")) as w:
        assert [r.width for r in Load(str(src).replace("[", "\\[").replace("]", "\\]")).dataset().collect()] == [8]
        assert w.memo.count("load(*") == 2
    (src / "a b.png").write_bytes(encode_png(picture(9, 4)))  # images are taken not to change
    (src / "{c}.png").write_bytes(encode_png(picture(7, 4)))
    with Workspace(spark, str(tmp_path / "w")) as w:
        assert sorted(r.width for r in Load(str(src).replace("[", "\\[").replace("]", "\\]")).dataset().collect()) == [7, 8]


def test_index_has_all_rows(spark, tmp_path):
    rows = spark.range(12_000).withColumnRenamed("id", "_pos").withColumn("name", F.concat(F.lit("<"), F.col("_pos").cast("string"))).withColumn("none", F.lit(None).cast("string"))
    page = "".join(index_html(rows))
    assert page.count("<tr>") == 12_001 and "&lt;11999" in page and "none" not in page
    clusters = rows.select(F.col("_pos").cast("string").alias("objectid"), F.lit("0").alias("root"), F.lit(12_000).alias("size"))
    shown = "".join(clusters_page(rows.select(F.col("_pos").cast("string").alias("objectid"), F.col("name").alias("original_path"), F.lit(1).alias("width"), F.lit(2).alias("height"), F.lit("PNG").alias("format")), clusters))
    assert shown.count("<img") == 12_000 and shown.count("<h2>") == 1


def test_shared_folder(spark, tmp_path):
    assert storage.qualified(spark, str(tmp_path)).startswith("file:/")
    fs, at = storage.filesystem(storage.qualified(spark, str(tmp_path)))
    assert at == str(tmp_path)
    with pytest.raises(ValueError):
        storage.filesystem("hdfs:/ck")
    before = storage.written()
    kept, gone = storage.materialise(spark.range(3)), storage.materialise(spark.range(4))
    new = sorted(storage.written() - before)
    assert len(new) == 2 and kept.count() == 3 and gone.count() == 4
    storage.release(before | {new[0]})
    assert storage.written() >= {new[0]} and new[1] not in storage.written() and not storage.exists(spark, new[1])


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    for few in (0, 1000):
        found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
        assert found == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}
        assert connected_components(spark.createDataFrame([], "a string, b string"), few=few).count() == 0
    named = spark.createDataFrame([("b", "c"), ("a", "b"), ("x", "y")], "a string, b string")
    assert {tuple(r) for r in connected_components(named).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_vector_classes(spark):
    """Hashed and by all pairs, in one list and in blocks; copies, zeros, nulls and repeated keys."""
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 8))
    m = base[np.arange(60) % 30] + 0.05 * rng.standard_normal((60, 8))
    rows = [(f"{i:03d}", [float(x) for x in v]) for i, v in enumerate(m)] + [(f"c{k}", [float(x) for x in m[0]]) for k in range(20)]
    near = [[np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) > 0.9 for _, b in rows] for _, a in rows]
    edges = [("z1", [0.0] * 8), ("z2", [0.0] * 8), (None, rows[0][1]), ("none", None), rows[3]]
    d = spark.createDataFrame(rows + edges, "k string, v array<double>")
    want = {"z1": ("z1", 0), "z2": ("z2", 0)}
    for i, (k, _) in enumerate(rows):
        todo, seen = [i], {i}
        while todo:
            at = todo.pop()
            new = {j for j in range(len(rows)) if near[at][j]} - seen
            seen |= new
            todo += new
        want[k] = min(rows[j][0] for j in seen), sum(near[i]) - 1
    for args in ({}, {"exact": True}, {"block": 7}):
        assert {r.k: (r.root, r.links) for r in vector_classes(d, "k", "v", 0.9, **args).collect()} == want
    assert sum(n > 0 for _, n in want.values()) >= 50
    assert vector_classes(d.limit(0), "k", "v", 0.9).count() == 0


def test_hash_plans():
    """Recall is kept whatever the signs; lists shrink as rows grow, and stay whole where hashing would not pay."""
    assert plan(2000, 0.4) == (0, 1) and plan(500, 0.95) == (0, 1)
    for n in (10**5, 10**7, 10**9):
        signs, tables = plan(n, 0.95)
        assert 1 - (1 - (1 - math.acos(0.95) / math.pi) ** signs) ** tables >= 0.99 and n / 2**signs < n / 20
    rng = np.random.default_rng(1)
    a = rng.standard_normal((300, 32))
    b = a / np.linalg.norm(a, axis=1, keepdims=True) * 0.951 + 0.0
    side = rng.standard_normal((300, 32))
    side -= (side * a).sum(axis=1, keepdims=True) / (a * a).sum(axis=1, keepdims=True) * a
    b += side / np.linalg.norm(side, axis=1, keepdims=True) * (1 - 0.951**2) ** 0.5
    signs, tables = plan(10**7, 0.95)
    met = np.zeros(300, bool)
    for t in range(tables):
        along = np.random.default_rng([23, t]).standard_normal((32, signs))
        met |= ((a @ along > 0) == (b @ along > 0)).all(axis=1)
    assert met.mean() >= 0.97


def test_command_line(spark, tmp_path, capsys):
    m = MemoStore(spark, str(tmp_path / "w" / "memo"))
    m.put_one("f(1)", "a")
    assert main(["-w", str(tmp_path / "w"), "cache", "list"], spark) == 0 and "f(1)" in capsys.readouterr().out
    ObjectStore(spark, str(tmp_path / "w" / "objects")).put(spark.createDataFrame([(b"x",), (b"y",), (None,)], "content binary"))
    assert main(["-w", str(tmp_path / "v"), "cache", "import", str(tmp_path / "w")], spark) == 0 and "2 objects and 1 entries" in capsys.readouterr().out
    assert main(["-w", str(tmp_path / "v"), "cache", "import", str(tmp_path / "w"), str(tmp_path / "v")], spark) == 0 and ": 0 objects" in capsys.readouterr().out
    assert main(["-w", str(tmp_path / "w"), "exec", "out = From(workspace.spark.range(3).withColumnRenamed('id', '_pos')) >> Info"], spark) == 0 and "image 2" in capsys.readouterr().out
    assert main(["-w", str(tmp_path / "w"), "cache", "clear", "-f"], spark) == 0 and m.count() == 0
    script = tmp_path / "s.py"
    script.write_text("out = From(workspace.spark.range(3).withColumnRenamed('id', '_pos')) >> Take(2)\n")
    assert main(["-w", str(tmp_path / "w"), "run", str(script)], spark) == 0
    with pytest.raises(SystemExit):
        main(["nonsense"], spark)


def test_downloads(spark, tmp_path):
    source = tmp_path / "model.bin"
    source.write_bytes(bytes(3_000_000))
    cache = DownloadCache(spark, str(tmp_path / "cache"))
    url = source.as_uri()
    path = cache.fetch(url)
    fs, at = storage.filesystem(path)
    assert path.endswith(".bin") and Path(at).read_bytes() == bytes(3_000_000)
    source.unlink()
    assert cache.fetch(url) == path  # it is there
    with pytest.raises(OSError):
        cache.fetch(url + "x", "models/other")
    assert [p.name for p in (tmp_path / "cache").rglob("*") if p.is_file() and not p.name.startswith(".")] == [Path(at).name]


def test_no_process_names_all_files(spark, tmp_path):
    """Listing and ingest leave no names of images with the driver: the plan scans a table of names, the stream's log has that table's files."""
    from framewright.sources.images import list_images, read_images

    want = []
    for k in range(60):
        at = tmp_path / "in" / f"d{k % 3}" / ("deep" if k % 2 else "")
        at.mkdir(parents=True, exist_ok=True)
        (at / f"p{k} é.png").write_bytes(encode_png(picture(8, 4, seed=k)))
        want.append(str(at / f"p{k} é.png"))
    for name in (".hidden.png", "_also.png", "no image.txt"):
        (tmp_path / "in" / name).write_bytes(b"x")
    (tmp_path / "in" / "_temporary").mkdir()
    (tmp_path / "in" / "_temporary" / "q.png").write_bytes(encode_png(picture(3, 3)))
    found = list_images(spark, f"{tmp_path}/i?")
    assert sorted(r.original_path for r in found.collect()) == sorted(want)
    assert len(found.inputFiles()) < 60 and not any(x.endswith(".png") for x in found.inputFiles())
    assert sorted((r.original_path, bytes(r.content)) for r in read_images(spark, str(tmp_path / "in"), True).collect()) == sorted((p, Path(p).read_bytes()) for p in want)
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 60
    logs = [p.read_text() for p in (tmp_path / "c" / "sources").rglob("*") if p.is_file() and not p.name.startswith(".")]
    assert logs and not any(".png" in x for x in logs)
    with pytest.raises(FileNotFoundError):
        list_images(spark, str(tmp_path / "none"))


@pytest.mark.parametrize(("threshold", "strict"), [(0.4, True), (0.95, False)])
def test_scan_of_all_pairs(spark, monkeypatch, threshold, strict):
    """Every pair is met once, through few coordinates or all, and copies count; the edges are fewer than the pairs."""
    from framewright import scan
    from framewright.scan import near_links, plan_turn

    if threshold > 0.9:
        monkeypatch.setattr(scan, "WHOLE", 1.0)  # few vectors, many of them near

    rng = np.random.default_rng(5)
    m = rng.standard_normal((50, 40))[np.arange(300) % 50] + 0.16 * rng.standard_normal((300, 40))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert (plan_turn(u.astype(np.float32), threshold) is None) == (threshold == 0.4)
    near = (u @ u.T > threshold) & ~np.eye(300, dtype=bool)
    copies = np.arange(300) % 3 + 1
    kinds = spark.createDataFrame([(k, int(copies[k]), m[k].tolist()) for k in range(300)], "kind long, copies long, v array<double>")
    edges, links = near_links(kinds, 300, 40, threshold, strict, least=20)
    assert {r.kind: r.near for r in links.collect()} == {k: int(n) for k, n in enumerate(near @ copies) if n}
    pairs = [(r.a, r.b) for r in edges.collect()]
    assert 100 <= len(pairs) < near.sum() / 2
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    i, j = np.nonzero(near)
    assert all(roots[a] == roots[b] for a, b in zip(i.tolist(), j.tolist(), strict=True))
