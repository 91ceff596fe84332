import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.models.codec import decode_png, encode_png
from framewright.models.runner import Backend, EchoBackend, FunctionBackend
from framewright.nodes import (
    Abort, AestheticScore, Anonymize, ClipEmbed, ConvertFormat, CropToAspect, Downscale, EdgeWatermarkRemoval, Florence2Caption, From, GPT4oCaption, GeminiCaption, Gemma3Caption, HumanCaption, HumanFilter, HumanTag, JoyCaptionAlphaOne,
    JoyCaptionAlphaTwo, LLMCaptionTransform, LLMCaptionVariations, LlamaCaption, MolmoCaption, NudeNet, QwenVLCaption, SmartHumanFilter, Upscale, XGenMMCaption,
)
from framewright.operators.captions import one_prompt, two_prompt
from framewright.operators.decisions import import_decisions
from framewright.operators.detection import cover, decode_heatmap, suppress
from framewright.frame import in_order

SIMPLE = [GPT4oCaption, GeminiCaption, LlamaCaption, QwenVLCaption, Gemma3Caption, MolmoCaption, XGenMMCaption, Florence2Caption, JoyCaptionAlphaOne, JoyCaptionAlphaTwo]


@pytest.mark.parametrize("kind", SIMPLE)
def test_captions(images, workspace, kind):
    rows = (From(images) >> kind(backend=EchoBackend())).dataset().collect()
    assert len(rows) == 10 and all(r.caption and r.objectid[:8] in r.caption for r in rows)
    again = (From(images) >> kind(backend=FunctionBackend(lambda x: 1 / 0))).dataset().collect()  # all is memoised
    assert sorted(r.caption for r in again) == sorted(r.caption for r in rows)


def test_refusals_failures_and_hooks(images, workspace):
    answers = FunctionBackend(lambda x: "I'm sorry, no" if x["objectid"].endswith("1") else 1 / 0 if x["objectid"].endswith("2") else "<ok>")
    rows = {r._pos: r.caption for r in (From(images) >> GPT4oCaption(backend=answers)).dataset().collect()}
    assert rows[1] is None and rows[2] is None and rows[3] == "<ok>"
    rows = {r._pos: r.caption for r in (From(images) >> GPT4oCaption(backend=EchoBackend())).dataset().collect()}
    assert rows[1] is None and rows[2] is not None  # a refusal is kept, a failure tried again
    with pytest.raises(Abort):
        (From(images) >> MolmoCaption()).dataset().collect()

    class Slow(Backend):
        retries, wait = 2, 0.0

        def open(self):
            self.left = 2

        def run(self, items):
            if self.left:
                self.left -= 1
                raise OSError("busy")
            return ["done" for _ in items]

    assert {r.caption for r in (From(images.coalesce(1)) >> XGenMMCaption(backend=Slow())).dataset().collect()} == {"done"}


def test_prompts():
    assert len({one_prompt(t, tone, n) for t, tone in (("descriptive", "formal"), ("descriptive", "informal"), ("booru", "formal"), ("stable_diffusion", "formal")) for n in ("any", 30, "short")}) == 12
    assert one_prompt("booru", "informal", "any") == one_prompt("booru", "formal", None)
    assert two_prompt("descriptive", "40") == two_prompt("descriptive", 40)
    assert two_prompt("art_critic", "any", ["Call them {name}."], "Ann").endswith("Call them Ann.")
    for bad in (lambda: one_prompt("x", "formal", 1), lambda: two_prompt("x", 1)):
        with pytest.raises(ValueError):
            bad()


def test_language_models(images, workspace, spark):
    calls = FunctionBackend(lambda x: f"<{x['prompt']}>")
    out = (From(images) >> LLMCaptionTransform("m", F.concat(F.lit("say "), (F.col("_pos") % 2).cast("string")), "said", backend=calls)).dataset()
    assert {r.said for r in out.collect()} == {"<say 0>", "<say 1>"} and workspace.memo.count("llm(*") == 2
    varied = (From(images) >> LLMCaptionVariations(variations=2, backend=FunctionBackend(lambda x: f"{x['variation']}"))).dataset()
    rows = in_order(varied).collect()
    assert len(rows) == 10 + 8 * 2 and [r.original_path for r in rows[:10]] == [f"/in/p{k}.png" for k in range(10)]
    assert [r.caption for r in rows[10:14]] == ["0", "1", "0", "1"] and rows[10].original_path == rows[11].original_path == "/in/p0.png"
    assert (From(images) >> LLMCaptionVariations(variations=0, backend=EchoBackend())).dataset().count() == 10


def test_human_filter(images, workspace, spark):
    with pytest.raises(Abort):
        (From(images) >> HumanFilter()).dataset()
    op = HumanFilter()
    assert spark.read.parquet(op.pending_path()).count() == images.select("objectid").distinct().count()
    import_decisions(workspace, "humanfilter", images.filter("_pos < 4").select("objectid", (F.col("_pos") % 2 == 0).alias("passed")))
    kept = (From(images) >> HumanFilter(skip_ui=True)).dataset()
    assert sorted(r._pos for r in kept.collect()) == [0, 2, 4, 6, 7, 8, 9]  # 1, 3 and 5, which is 1 by content, are rejected
    assert (From(images) >> HumanFilter("other", skip_ui=True)).dataset().count() == 10
    for bad in (images.select("objectid"), images.select("objectid", F.lit(None).cast("boolean").alias("passed"))):
        with pytest.raises(ValueError):
            import_decisions(workspace, "humanfilter", bad)


def test_human_tag_and_caption(images, workspace):
    rows = images.filter("_pos in (0, 2)").select("objectid", F.lit(1).alias("version"), F.array(F.lit("cat")).alias("tags"), (F.col("_pos") == 2).alias("rejected"))
    import_decisions(workspace, "humantag", rows, vocabulary=["cat", "dog"])
    tagged = images.withColumn("tags", F.array(F.lit("dog"), F.lit("old")))
    out = {r._pos: r.tags for r in (From(tagged) >> HumanTag(tags=[["cat"], ["dog"]], skip_ui=True)).dataset().collect()}
    assert out[0] == ["cat", "old"] and len(out) == 10  # work is left, so nothing is dropped
    only = tagged.filter("_pos in (0, 2)")
    assert [r._pos for r in (From(only) >> HumanTag(tags=["cat", "dog"])).dataset().collect()] == [0]
    with pytest.raises(ValueError):
        import_decisions(workspace, "humantag", rows, vocabulary=["dog"])
    with pytest.raises(ValueError):
        HumanTag()
    import_decisions(workspace, "humancaption", images.filter("_pos in (0, 1)").select("objectid", F.lit(1).alias("version"), F.when(F.col("_pos") == 0, "mine").otherwise("").alias("caption")))
    out = {r._pos: r.caption for r in (From(images) >> HumanCaption(version=2, skip_ui=True)).dataset().collect()}
    assert out[0] == "mine" and out[1] == "cap 1"


def test_smart_filter(spark, workspace):
    rng = np.random.default_rng(1)
    rows = [(k, f"{k:064x}", [float(x) for x in rng.standard_normal(4) + (2 if k % 3 else -2)]) for k in range(240)]
    d = spark.createDataFrame(rows, "_pos long, objectid string, clip array<double>")
    import_decisions(workspace, "humanfilter", d.filter("_pos < 180").select("objectid", (F.col("_pos") % 3 > 0).alias("passed")))
    args = {"min_images": 100, "min_per_class": 20, "epochs": 60}
    kept = {r._pos for r in (From(d) >> SmartHumanFilter(**args)).dataset().collect()}
    assert all(k % 3 for k in kept) and len(kept) > 150
    assert workspace.memo.count("smartfilter*") > 40
    for bad in ({"min_images": 1000}, {**args, "min_per_class": 100}, {**args, "min_accuracy": 1.1, "domain": "x"}):
        with pytest.raises(Abort):
            (From(d) >> SmartHumanFilter(**bad)).dataset()


def test_derived(images, workspace):
    out = (From(images) >> ClipEmbed(backend=FunctionBackend(lambda x: [1.0, 2.0])) >> AestheticScore(backend=FunctionBackend(lambda x: 4.5))).dataset()
    assert out.filter("clip = array(1f, 2f) and aesthetic_score = 4.5").count() == 10
    seen = FunctionBackend(lambda x: [{"class": "FEMALE_BREAST_EXPOSED", "score": 0.5, "box": [0, 0, 1, 1]}])
    a = (From(images) >> NudeNet(0.5, backend=seen)).dataset()
    assert a.filter("has_nudity and has_female and not has_male").count() == 10
    assert (From(images) >> NudeNet(0.6)).dataset().filter("has_nudity").count() == 0  # asks no model


def pictures(spark):
    rng = np.random.default_rng(3)
    rows = [(k, encode_png(rng.integers(0, 256, (60, 100, 3), dtype=np.uint8)), 100, 60, "PNG", "/x.png") for k in range(3)] + [(3, b"broken", 100, 60, "PNG", "/y.png"), (4, None, 100, 60, "PNG", "/z.png")]
    return spark.createDataFrame(rows, "_pos long, content binary, width int, height int, format string, original_path string").withColumn("objectid", F.sha2(F.coalesce("content", F.lit(b"")), 256))


def test_pixels(spark, workspace):
    d = pictures(spark)
    for op, shape in ((lambda: CropToAspect([1.0]), (60, 60)), (lambda: Downscale(max_edge=50), (30, 50)), (lambda: Upscale(min_edge=120), (120, 200))):
        rows = (From(d) >> op()).dataset().orderBy("_pos").collect()
        assert all(decode_png(bytes(r.content)).shape[:2] == shape == (r.height, r.width) for r in rows[:3])
        assert rows[3].error and bytes(rows[3].content) == b"broken" and rows[4].content is None
        assert len({r.objectid for r in rows[:3]} | {r.objectid for r in d.collect()}) == 8
    assert (From(d) >> ConvertFormat("PNG")).dataset().filter("error is not null").count() == 0


def test_watermarks(spark, workspace):
    mark = FunctionBackend(lambda x: [{"x1": 0.0, "y1": 20.0, "x2": 10.9, "y2": 25.0, "label": "logo"}])
    rows = (From(pictures(spark)) >> EdgeWatermarkRemoval(backend=mark)).dataset().orderBy("_pos").collect()
    assert rows[0].width == 90 and decode_png(bytes(rows[0].content)).shape == (60, 90, 3) and rows[0].watermark_info.did_modify
    none = (From(pictures(spark)) >> EdgeWatermarkRemoval(0.1, backend=FunctionBackend(lambda x: []))).dataset()
    assert none.filter("watermark_info.did_modify or width <> 100").count() == 0


@pytest.mark.parametrize("method", ["blur", "solid", "none", "mosaic"])
def test_anonymize(spark, workspace, method):
    face = FunctionBackend(lambda x: [{"x1": 10.0, "y1": 10.0, "x2": 29.0, "y2": 29.0, "score": 0.9}, {"x1": 11.0, "y1": 10.0, "x2": 30.0, "y2": 29.0, "score": 0.8}, {"x1": 60.0, "y1": 10.0, "x2": 70.0, "y2": 20.0, "score": 0.3}])
    before = [decode_png(bytes(r.content)) for r in pictures(spark).orderBy("_pos").limit(3).collect()]
    rows = (From(pictures(spark)) >> Anonymize(method, ellipse=False, backend=face)).dataset().orderBy("_pos").collect()
    assert len(rows[0].faces) == 1
    after = decode_png(bytes(rows[0].content))
    changed = (after != before[0]).any(axis=2)
    assert not changed[:, 40:].any() and changed[12:28, 12:28].any() == (method != "none")


def suppressed_by_force(boxes, limit=0.3):
    left, kept = sorted(range(len(boxes)), key=lambda i: -boxes[i][4]), []
    for i in left:
        a = boxes[i]
        for k in kept:
            b = boxes[k]
            both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            if both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both) >= limit:
                break
        else:
            kept.append(i)
    return sorted(kept)


def test_suppression():
    rng = np.random.default_rng(0)
    for n in (1, 2, 40):
        b = rng.uniform(0, 50, (n, 2))
        boxes = np.concatenate([b, b + rng.uniform(5, 30, (n, 2)), rng.uniform(0, 1, (n, 1))], axis=1)
        assert list(suppress(boxes)) == suppressed_by_force(boxes.tolist())
    assert list(suppress(np.array([[0, 0, 4, 4, 0.9], [2, 1, 6, 5, 0.8]]))) == [0, 1]  # they share 6 of 26
    assert len(suppress(np.zeros((0, 5)))) == 0 and list(suppress(np.zeros((2, 5)))) == [0, 1]


def test_heatmap_and_cover():
    heat = np.zeros((8, 8))
    heat[2, 3] = 0.9
    found = decode_heatmap(heat, np.full((2, 8, 8), np.log(2.0)), np.zeros((2, 8, 8)), 32, 32, 0.5)
    assert found.tolist() == [[10.0, 6.0, 18.0, 14.0, 0.9]] and len(decode_heatmap(heat, np.zeros((2, 8, 8)), np.zeros((2, 8, 8)), 32, 32, 0.95)) == 0
    p = np.full((10, 10, 3), 200, np.uint8)
    whole = [{"x1": 0, "y1": 0, "x2": 9, "y2": 9}]
    for ellipse in (True, False):
        assert (cover(p, whole, "solid", ellipse, 4) == 0).all()  # a solid box has corners
    rng = np.random.default_rng(1)
    p = rng.integers(0, 256, (20, 20, 3), dtype=np.uint8)
    box = [{"x1": 4, "y1": 2, "x2": 16, "y2": 14}]
    blurred, round_ = cover(p, box, "blur", False, 4), cover(p, box, "blur", True, 4)
    part, size = p[2:14, 4:16].astype(float), 6
    mirrored = np.pad(part, [(3, 2), (3, 2), (0, 0)], mode="reflect")
    want = np.array([[mirrored[y : y + size, x : x + size].mean(axis=(0, 1)) for x in range(12)] for y in range(12)])
    assert np.abs(blurred[2:14, 4:16] - want).max() <= 0.5 and (blurred[:2] == p[:2]).all() and (blurred[:, 16:] == p[:, 16:]).all()
    assert (round_[2, 4] == p[2, 4]).all() and (round_[8, 10] == blurred[8, 10]).all()
    tiles = cover(p, box, "mosaic", True, 5)
    assert (tiles[2:7, 4:9] == p[2, 4]).all() and (tiles[12:15, 14:17] == p[12, 14]).all() and (tiles[15:] == p[15:]).all()


def test_what_models_see(spark, workspace):
    """Contents are scaled or cut for the models that ask for it; failed calls are made again."""
    size = FunctionBackend(lambda x: "x".join(map(str, decode_png(x["content"]).shape[:2])) if x["content"] and x["content"][:4] == b"\x89PNG" else "none")
    d = pictures(spark)
    rows = (From(d) >> QwenVLCaption("q", backend=size) >> XGenMMCaption("x", backend=size)).dataset().orderBy("_pos").collect()
    assert [r.q for r in rows] == ["768x1280"] * 3 + ["none"] * 2 and [r.x for r in rows] == ["52x100"] * 3 + ["none"] * 2
    assert [bytes(r.content) for r in rows[:3]] == [bytes(r.content) for r in d.orderBy("_pos").limit(3).collect()]
    calls, waits = [], []

    class Flaky(EchoBackend):
        def run(self, items):
            calls.append(len(items))
            if len(calls) < 4:
                raise RuntimeError("busy")
            return super().run(items)

    import framewright.models.runner as runner

    sleep, runner.time.sleep = runner.time.sleep, waits.append
    try:
        assert Flaky().attempt([{"prompt": "a"}], 10, 2.0) == ["a []"] and waits == [2.0, 4.0, 8.0]
    finally:
        runner.time.sleep = sleep
    assert GeminiCaption.retries == 10


def test_smart_filter_keeps_its_model(spark, workspace, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, f"{k:064x}", [float(x) for x in rng.standard_normal(4) + (2 if k % 3 else -2)]) for k in range(240)]
    d = spark.createDataFrame(rows, "_pos long, objectid string, clip array<double>")
    import_decisions(workspace, "humanfilter", d.filter("_pos < 180").select("objectid", (F.col("_pos") % 3 > 0).alias("passed")))
    args = {"min_images": 100, "min_per_class": 20, "epochs": 60}
    first = sorted(r._pos for r in (From(d) >> SmartHumanFilter(**args)).dataset().collect())
    workspace.memo.clear("smartfilter*")
    monkeypatch.setattr("framewright.operators.smart.MultilayerPerceptronClassifier", None)  # can't be fitted again
    assert sorted(r._pos for r in (From(d) >> SmartHumanFilter(**args)).dataset().collect()) == first
