import pytest
from pyspark.sql import functions as F

from framewright.frame import in_order
from framewright.functions import geometry as G
from framewright.functions import strings as S
from framewright.functions import tags as T
from framewright.functions.keys import memo_key, memo_key_column
from framewright.nodes import (
    Abort, AddTags, Apply, Concat, CropToAspect, Downscale, ExactDedupe, Fail, Filter, FilterByAspectRatio, FilterBySize, From, FuzzyDedupe, Info, Map, MapCaption, RemoveTags, RewriteTags, Set, SetCaption, Shuffle, Sorted, Take, Upscale,
)
from framewright.queries import piped


def names(df):
    return [r.original_path for r in in_order(df).collect()]


def test_filters_ignore_zero_and_keep_bounds(spark, images):
    assert len(names(piped(spark, images, lambda: FilterBySize(min_width=0, max_edge=0)))) == 10
    assert names(piped(spark, images, lambda: FilterBySize(min_width=1000))) == ["/in/p9.png"]
    assert names(piped(spark, images, lambda: FilterBySize(max_edge=600))) == [f"/in/p{k}.png" for k in range(6)]
    assert names(piped(spark, images, lambda: FilterByAspectRatio(1, 1))) == ["/in/p5.png"]


def test_filter_drops_null_and_takes_functions(spark, images):
    assert len(names(piped(spark, images, lambda: Filter(F.col("caption") != "cap 1")))) == 8
    assert len(names(piped(spark, images, lambda: Filter(lambda r: r.width > 500)))) == 5


def test_map_and_apply(spark, images):
    out = piped(spark, images, lambda: Map(lambda r: r._replace(caption="x"), rows=True))
    assert {r.caption for r in out.collect()} == {"x"}
    assert piped(spark, images, lambda: Apply(half=F.col("width") / 2)).filter("half = width / 2").count() == 10


def test_empty(spark, images):
    none = images.limit(0)
    for make in (ExactDedupe, lambda: Take(3), lambda: Sorted("score"), lambda: AddTags("a"), lambda: CropToAspect([1.0]), Shuffle, lambda: FilterBySize(min_edge=3)):
        assert piped(spark, none, make).count() == 0


def test_exact_dedupe_keeps_the_first(spark, images):
    kept = names(piped(spark, images, ExactDedupe))
    assert "/in/p1.png" in kept and "/in/p5.png" not in kept and "/in/p0.png" in kept and "/in/p9.png" not in kept
    twice = piped(spark, images, ExactDedupe, ExactDedupe)
    assert names(twice) == kept


def test_sorted_is_stable_both_ways(spark, images):
    up = [int(n[5:-4]) for n in names(piped(spark, images, lambda: Sorted("score")))]
    down = [int(n[5:-4]) for n in names(piped(spark, images, lambda: Sorted("score", reverse=True)))]
    assert up == sorted(range(10), key=lambda k: k % 4) and down == sorted(range(10), key=lambda k: k % 4, reverse=True)


def test_take(spark, images):
    assert len(names(piped(spark, images, lambda: Take(99)))) == 10
    a = names(piped(spark, images, lambda: Take(4, random=True, seed=1)))
    assert a == names(piped(spark, images.repartition(5), lambda: Take(4, random=True, seed=1))) and len(set(a)) == 4
    with pytest.raises(ValueError):
        piped(spark, images, lambda: Take(-1))


def test_captions(spark, images):
    out = {r._pos: r.caption for r in piped(spark, images, lambda: MapCaption(F.upper)).collect()}
    assert out[1] == "CAP 1" and out[3] is None and out[4] == ""
    out = {r._pos: r.caption for r in piped(spark, images, lambda: MapCaption(lambda c: c + "!", rows=True)).collect()}
    assert out[1] == "cap 1!" and out[3] is None and out[4] == ""
    assert piped(spark, images, lambda: SetCaption("x")).filter("caption = 'x'").count() == 10


def test_set_sees_earlier(spark, images):
    out = piped(spark, images, lambda: Set(a=1, b=F.col("a") + 1, c={"y", "x"}, d=lambda df: df["width"]))
    assert out.filter("b = 2 and c = array('x', 'y') and d = width").count() == 10


def test_tags(spark, images):
    out = piped(spark, images, lambda: AddTags(["b", "a"]), lambda: RewriteTags({"a": "b"}), lambda: AddTags("c"), lambda: RemoveTags("zz"))
    assert out.filter("tags = array('b', 'c')").count() == 10
    assert piped(spark, images, lambda: RemoveTags("a")).filter("tags is null").count() == 10
    twice = spark.range(1).select(T.add_tags(T.add_tags(F.lit(None).cast("array<string>"), ["q"]), ["q"]).alias("t")).first().t
    assert twice == ["q"]


def test_concat_and_order(spark, images, workspace):
    a = From(images)
    both = Concat << (a >> Filter("_pos < 2")) << (a >> Filter("_pos >= 8"))
    assert names(both.dataset()) == ["/in/p0.png", "/in/p1.png", "/in/p8.png", "/in/p9.png"]


def test_fail_stops_the_rest(images, workspace):
    From(images) >> Fail("no")
    From(images) >> Take(1)
    assert workspace.run() == []


def test_operators_without_result(images, workspace):
    class Nothing(type(From(images))):
        def eval(self):
            return None

    with pytest.raises(Abort):
        Nothing(images).dataset()
    with pytest.raises(Abort):
        (From(images) >> Take(1) << From(images)).dataset()


def test_info_elides(spark, images, workspace, capsys):
    long = images.limit(1).withColumn("many", F.sequence(F.lit(1), F.lit(60)))
    assert len(Info().table(long).first().many) == 51
    assert "_pos" not in Info().table(long).columns


def test_fuzzy(spark, images, workspace):
    vectors = images.filter("_pos not in (5, 9)").withColumn("clip", F.when(F.col("_pos") < 5, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    kept = (From(vectors) >> FuzzyDedupe(0.9)).dataset()
    assert sorted(r.width for r in kept.collect()) == [500, 900]
    with pytest.raises(Abort):
        (From(vectors.withColumn("clip", F.when(F.col("_pos") > 0, F.col("clip")))) >> FuzzyDedupe()).dataset()


def test_geometry(spark):
    d = spark.createDataFrame([(1024, 512), (512, 1024), (300, 200), (7, 3)], "width int, height int")
    w, h = F.col("width"), F.col("height")
    assert [tuple(r.s) for r in d.select(G.fit_max_edge(w, h, 256).alias("s")).collect()] == [(256, 128), (128, 256), (256, 170), (7, 3)]
    assert [tuple(r.s) for r in d.select(G.grow_min_edge(w, h, 512).alias("s")).collect()][2] == (768, 512)
    assert d.select(G.nearest_ratio(F.lit(3), F.lit(2), [1.0, 2.0]).alias("r")).first().r == 1.0
    boxes = "array<struct<x1:int,y1:int,x2:int,y2:int>>"
    cut = lambda b: spark.createDataFrame([(b,)], f"b {boxes}").select(G.edge_crop(F.lit(1000), F.lit(1000), F.col("b")).alias("c")).first().c
    assert tuple(cut([(0, 500, 40, 520)])) == (40, 0, 1000, 1000, True)
    assert tuple(cut([(0, 990, 100, 1000)])) == (0, 0, 1000, 990, True)  # two edges: the lesser depth
    assert tuple(cut([(400, 400, 500, 500)])) == (0, 0, 1000, 1000, False)
    assert tuple(cut([])) == (0, 0, 1000, 1000, False)


def test_scaling_errors(images, workspace):
    for make in (lambda: Downscale(), lambda: Downscale(max_edge=1, min_edge=1), lambda: CropToAspect([]), lambda: Upscale(method="X")):
        with pytest.raises(ValueError):
            make()


def test_strings(spark):
    d = spark.createDataFrame([("/a/b/näme.tar.gz",), ("x",), ("/a/.hidden",)], "p string")
    assert [r[0] for r in d.select(S.base_name(F.col("p"))).collect()] == ["näme.tar", "x", ".hidden"]
    assert [r[0] for r in d.select(S.extension(F.col("p"))).collect()][0] == ".gz"
    assert spark.createDataFrame([("a" * 90 + ".png", "id")], "p string, o string").select(S.save_stem(F.col("p"), F.col("o"))).first()[0] == "a" * 80 + "_id"
    assert spark.range(1).select(S.clean_caption(F.lit(" hi!! "))).first()[0] == "hi"


def test_keys(spark):
    assert memo_key("x") == "x" and memo_key("f", "v1", {"b": 1, "a": 2}) == 'f("v1",{"a"=2,"b"=1})'
    assert spark.range(1).select(memo_key_column("f", "v1", F.lit('q"'))).first()[0] == memo_key("f", "v1", 'q"')


def test_suppression_of_many_groups(spark):
    """Groups of all sizes at once keep what each keeps by itself, also with equal scores and boxes without area."""
    import numpy as np
    import pyarrow as pa

    from framewright.operators import detection

    rng, groups = np.random.default_rng(3), []
    for k in range(300):
        b = rng.integers(0, 20, (80 if k % 100 == 0 else k % 9, 5)).astype(float)
        b[:, 2:4] = b[:, :2] + rng.integers(0, 12, (len(b), 2))
        groups.append(None if k % 50 == 7 else b)
    names = ("x1", "y1", "x2", "y2", "score")
    column = pa.array([g if g is None else [dict(zip(names, r, strict=True)) for r in g.tolist()] for g in groups], pa.list_(pa.struct([(n, pa.float64()) for n in names])))
    alone = detection.suppress
    calls = []
    detection.suppress = lambda boxes: calls.append(1) or alone(boxes)
    try:
        found = detection._suppressed(column).to_pylist()
    finally:
        detection.suppress = alone
    assert found == [g if g is None else [dict(zip(names, r, strict=True)) for r in g[alone(g)].tolist()] for g in groups]
    assert len(calls) <= 3  # only groups of 80; before, one a group


def test_a_cut_is_worked_out_once(spark):
    from pyspark.sql import functions as F

    from framewright.functions import geometry as G

    rows = spark.sql("SELECT 1024 AS w, 768 AS h, array(named_struct('x1', 0, 'y1', 5, 'x2', 20, 'y2', 9)) AS boxes UNION ALL SELECT 1024, 768, NULL UNION ALL SELECT 1024, 768, array()")
    cut = rows.select(G.edge_crop(F.col("w"), F.col("h"), F.col("boxes")).alias("c")).select("c.left", "c.top", "c.right", "c.bottom", "c.modified")
    assert [tuple(r) for r in cut.collect()] == [(0, 9, 1024, 768, True), (0, 0, 1024, 768, False), (0, 0, 1024, 768, False)]
    plan = rows.repartition(2).select(G.edge_crop(F.col("w"), F.col("h"), F.col("boxes")).alias("c")).select("c.left", "c.right", "c.bottom")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(boxes") == 1
