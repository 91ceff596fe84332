"""Captions by models. All share one shape: a memo key of model, prompt and content; the misses go to a backend in batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.frame import POS, SRC, order_columns, prop, with_positions
from framewright.functions.keys import memo_key_column
from framewright.functions.strings import clean_caption
from framewright.models.codec import apply_pixels
from framewright.models.runner import Backend, backend_of, infer
from framewright.plans.operator import Operator

DESCRIBE = "Say in one paragraph what this picture shows."


def with_instructions(prompt: str, instructions: str | None) -> str:
    return f"{prompt}\n\n{instructions}" if instructions else prompt


def repainted(rows: DataFrame, change) -> DataFrame:
    """Rows whose contents are changed for a model; their identity is still that of the images."""
    if "content" not in rows.columns:
        return rows
    own = rows.select("_key", F.col("objectid").alias("_own"), "content", *(c for c in rows.columns if c not in ("_key", "objectid", "content", "format", "error")))
    return apply_pixels(own, change, F.struct(F.lit(1).alias("_")), F.lit(True)).withColumnRenamed("_own", "objectid")


def _has_text(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


class ModelCaption(Operator):
    """Base of the captioning operators: ``scope`` and ``version`` name the model in the memo key."""

    scope, version, batch_size = "caption", "v1", 1
    retries, wait = 0, 2.0  # of a batch that fails, beyond the backend's own

    def __init__(self, target_prop: str = "caption", prompt: str | None = None, instructions: str | None = None, batch_size: int | None = None, parallel: int | None = None, backend: Backend | None = None):
        super().__init__()
        self.target, self.prompt = target_prop, with_instructions(prompt or DESCRIBE, instructions)
        self.batch, self.backend = batch_size or parallel or type(self).batch_size, backend

    def segments(self) -> list[Any]:
        return [self.version, self.prompt]

    def finish(self, value: Column) -> Column:
        return value

    def prepared(self, misses: DataFrame) -> DataFrame:
        """The rows with their contents as the model is to see them; what can't be decoded stays as it is."""
        return misses

    def eval(self, dataset: DataFrame) -> DataFrame:
        key = memo_key_column(self.scope, *self.segments(), F.col("objectid"))
        inputs = {"objectid": F.col("objectid"), "prompt": F.lit(self.prompt), "scope": F.lit(self.scope)}
        if "content" in dataset.columns:
            inputs["content"] = F.col("content")
        elif "original_path" in dataset.columns:
            inputs["path"] = F.col("original_path")

        def work(misses: DataFrame) -> DataFrame:
            found = infer(self.prepared(misses), backend_of(self.scope, self.backend), inputs, self.batch, retries=self.retries, wait=self.wait)
            return found.withColumn("value", self.finish(F.col("value")))

        return self.workspace.memo.fill(dataset, key, work, self.target, scope=self.scope)


def _refused_to_null(value: Column, phrases: tuple[str, ...] = ("i'm sorry", "i can't assist", "i cannot assist")) -> Column:
    return F.when(reduce(lambda a, b: a | b, (F.lower(value).contains(p) for p in phrases)), F.lit(None)).otherwise(value)


class GPT4oCaption(ModelCaption):
    """A refusal is kept as null and so is not asked for again."""

    scope, version, batch_size = "gpt4o-caption", "v2", 8

    def finish(self, value: Column) -> Column:
        return _refused_to_null(value)


class GeminiCaption(ModelCaption):
    """A failed batch is tried again up to 10 times, after waits that double."""

    scope, version, batch_size = "gemini-2.0-flash", "v2", 2
    retries = 10


class LlamaCaption(ModelCaption):
    scope, batch_size = "llama-3.2-11B-vision", 1

    def finish(self, value: Column) -> Column:
        return F.trim(F.regexp_replace(value, r"^\s*assistant\s*", ""))


class QwenVLCaption(ModelCaption):
    """The model sees images with their shorter side at 768."""

    scope, short_edge = "qwen-vl", 768

    def prepared(self, misses: DataFrame) -> DataFrame:
        edge = self.short_edge

        def scaled(codec, pixels, _):
            h, w = pixels.shape[:2]
            return codec.resize(pixels, edge, int(h * (edge / w))) if w < h else codec.resize(pixels, int(w * (edge / h)), edge)

        return repainted(misses, scaled)


class Gemma3Caption(ModelCaption):
    scope = "gemma3-12b-it"


class MolmoCaption(ModelCaption):
    scope = "molmo-7B-D-0924"


class XGenMMCaption(ModelCaption):
    """The model sees images without 5 % at the top and 9 % at the bottom; output ends at its end mark."""

    scope, batch_size, margins, end = "xgen-mm", 4, (0.05, 0.09), "<|end|>"

    def prepared(self, misses: DataFrame) -> DataFrame:
        top, bottom = self.margins

        def cut(codec, pixels, _):
            h = pixels.shape[0]
            return codec.crop(pixels, 0, int(h * top), pixels.shape[1], max(1, h - int(h * top) - int(h * bottom)))

        return repainted(misses, cut)

    def finish(self, value: Column) -> Column:
        return F.trim(F.substring_index(value, self.end, 1))


class Florence2Task:
    CAPTION, DETAILED_CAPTION, MORE_DETAILED_CAPTION = "CAPTION", "DETAILED_CAPTION", "MORE_DETAILED_CAPTION"
    ALL = (CAPTION, DETAILED_CAPTION, MORE_DETAILED_CAPTION)


class Florence2Caption(ModelCaption):
    scope, batch_size = "florence2-large", 64

    def __init__(self, target_prop: str = "caption", task: str = Florence2Task.MORE_DETAILED_CAPTION, batch_size: int | None = None, backend: Backend | None = None):
        if task not in Florence2Task.ALL:
            raise ValueError(f"task must be one of {Florence2Task.ALL}")
        super().__init__(target_prop, f"<{task}>", None, batch_size, None, backend)
        self.task = task

    def segments(self) -> list[Any]:
        return [self.version, self.task]


def _length_kind(length: str | int | None) -> tuple[str, str | int | None]:
    """('any' | 'words' | 'size', the length); digits in a string count as a number."""
    if length is None or length == "any":
        return "any", None
    if isinstance(length, int) or str(length).isdigit():
        return "words", int(length)
    return "size", str(length)


_ENDING = {"any": "", "words": " Use {n} words at most.", "size": " Make it {n}."}
_ONE = {
    ("descriptive", "formal"): "Describe the picture in a formal voice.",
    ("descriptive", "informal"): "Describe the picture as one would to a friend.",
    ("stable_diffusion", "formal"): "Give a prompt from which an image generator would make this picture.",
    ("booru", "formal"): "List tags for this picture as an image board would.",
}
_TWO = {
    "descriptive": _ONE["descriptive", "formal"], "descriptive_informal": _ONE["descriptive", "informal"], "training_prompt": _ONE["stable_diffusion", "formal"],
    "midjourney": "Give a prompt in the style of prompt collections for this picture.", "booru_tag_list": _ONE["booru", "formal"],
    "booru_like_tag_list": "List tags for this picture much like an image board would.", "art_critic": "Judge the picture as an art critic: what it shows, how it is built, its light and style.",
    "product_listing": "Write of this picture as though it were for sale.", "social_media_post": "Write a post to go with this picture.",
}


def one_prompt(caption_type: str, tone: str, length: str | int | None) -> str:
    """The prompt of a type, a tone and a kind of length; lists and prompts are formal always."""
    tone = "formal" if caption_type in ("booru", "stable_diffusion") else tone
    if (caption_type, tone) not in _ONE:
        raise ValueError(f"no caption of type {caption_type} and tone {tone}")
    kind, n = _length_kind(length)
    return _ONE[caption_type, tone] + _ENDING[kind].format(n=n)


def two_prompt(caption_type: str, length: str | int | None, extra_options: list[str] | None = None, name_input: str | None = None) -> str:
    if caption_type not in _TWO:
        raise ValueError(f"no caption of type {caption_type}")
    kind, n = _length_kind(length)
    text = " ".join([_TWO[caption_type] + _ENDING[kind].format(n=n), *(extra_options or [])])
    return text.replace("{name}", name_input or "").replace("{length}", str(length)).replace("{word_count}", str(length))


class JoyCaptionAlphaOne(ModelCaption):
    scope, batch_size = "joycaption", 4

    def __init__(self, target_prop: str = "caption", caption_type: str = "descriptive", caption_tone: str = "formal", caption_length: str | int = "any", batch_size: int | None = None, backend: Backend | None = None):
        super().__init__(target_prop, one_prompt(caption_type, caption_tone, caption_length), None, batch_size, None, backend)
        self.facts = [self.version, caption_type, caption_tone, caption_length]

    def segments(self) -> list[Any]:
        return self.facts

    def finish(self, value: Column) -> Column:
        return clean_caption(value)


class JoyCaptionAlphaTwo(ModelCaption):
    scope, version, batch_size = "joycaption2", "v2", 4

    def __init__(self, target_prop: str = "caption", caption_type: str = "descriptive", caption_length: str | int = "any", extra_options: list[str] | None = None, name_input: str | None = None, batch_size: int | None = None, backend: Backend | None = None):
        super().__init__(target_prop, two_prompt(caption_type, caption_length, extra_options, name_input), None, batch_size, None, backend)
        self.facts = [self.version, caption_type, caption_length, extra_options or [], name_input]

    def segments(self) -> list[Any]:
        return self.facts

    def finish(self, value: Column) -> Column:
        return F.trim(value)


class LLMCaptionTransform(Operator):
    """``target_prop`` from a language model's answer to a prompt, a column; equal prompts share one call."""

    def __init__(self, model: str, prompt: Column | Callable[[DataFrame], Column], target_prop: str = "caption", parallel: int = 20, temperature: float = 0.5, backend: Backend | None = None):
        super().__init__()
        self.model, self.prompt, self.target, self.parallel, self.temperature, self.backend = model, prompt, target_prop, parallel, temperature, backend

    def eval(self, dataset: DataFrame) -> DataFrame:
        prompt = self.prompt if isinstance(self.prompt, Column) else self.prompt(dataset)
        key = memo_key_column("llm", self.model, {"temperature": self.temperature}, prompt)
        inputs = {"prompt": prompt, "model": F.lit(self.model), "temperature": F.lit(self.temperature)}
        return self.workspace.memo.fill(dataset, key, lambda m: infer(m, backend_of("llm", self.backend), inputs, self.parallel), self.target, scope="llm")


def variation_rows(df: DataFrame, variations: int, target: str = "caption") -> DataFrame:
    """Rows to be varied, ``variations`` for each with a caption, with ``_variation``; in the order of their images, then of the index."""
    if variations < 0:
        raise ValueError("variations must not be negative")
    some = df.filter(_has_text(F.col(target)))
    return some.withColumn("_variation", F.explode(F.sequence(F.lit(0), F.lit(variations - 1)))) if variations else some.withColumn("_variation", F.lit(0)).limit(0)


def caption_variations(df: DataFrame, variations: int, new: Callable[[Column, Column], Column], target: str = "caption") -> DataFrame:
    """The rows, then for each with a caption ``variations`` more whose caption is ``new(caption, index)``."""
    return _after(df, variation_rows(df, variations, target).withColumn(target, new(F.col(target), F.col("_variation"))))


def _after(df: DataFrame, extra: DataFrame) -> DataFrame:
    keys = order_columns(df)
    both = df.withColumn("_variation", F.lit(-1)).withColumn("_later", F.lit(0)).unionByName(extra.withColumn("_later", F.lit(1)))
    return with_positions(both.withColumnsRenamed({k: f"_was{k}" for k in keys}), "_later", *(f"_was{k}" for k in keys), "_variation").drop("_later", "_variation", *(f"_was{k}" for k in (POS, SRC)))


class LLMCaptionVariations(Operator):
    def __init__(self, target_prop: str = "caption", variations: int = 2, instructions: str | None = None, parallel: int = 20, temperature: float = 0.7, model: str = "default", backend: Backend | None = None):
        super().__init__()
        self.target, self.variations, self.instructions, self.parallel, self.temperature, self.model, self.backend = target_prop, variations, instructions, parallel, temperature, model, backend

    def eval(self, dataset: DataFrame) -> DataFrame:
        dataset = prop(dataset, self.target, "string")
        rows = variation_rows(dataset, self.variations, self.target)
        facts = F.concat(F.to_json(F.struct(F.lit(self.instructions).alias("instructions"), F.lit(self.temperature).alias("temperature"), F.col("_variation").alias("variation_index"), F.lit(1).alias("version"))))
        key = memo_key_column("llm", self.model, facts, F.col(self.target))
        prompt = F.concat(F.lit(with_instructions("Say the same as this caption in other words.", self.instructions) + "\n\n"), F.col(self.target))
        inputs = {"prompt": prompt, "model": F.lit(self.model), "temperature": F.lit(self.temperature), "variation": F.col("_variation")}
        made = self.workspace.memo.fill(rows, key, lambda m: infer(m, backend_of("llm", self.backend), inputs, self.parallel), "_varied", scope="llm")
        return _after(dataset, made.withColumn(self.target, F.col("_varied")).drop("_varied"))
