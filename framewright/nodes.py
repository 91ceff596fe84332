"""Every operator of the pipeline language by its name."""

from framewright.operators.basic import Apply, Concat, Fail, Filter, FilterByAspectRatio, FilterBySize, From, Info, Load, Map, MapCaption, Passthrough, Set, SetCaption, Shuffle, Sleep, Sorted, Take
from framewright.operators.captions import (
    Florence2Caption, Florence2Task, GeminiCaption, Gemma3Caption, GPT4oCaption, JoyCaptionAlphaOne, JoyCaptionAlphaTwo, LlamaCaption, LLMCaptionTransform, LLMCaptionVariations, MolmoCaption, QwenVLCaption, XGenMMCaption,
)
from framewright.operators.decisions import HumanCaption, HumanFilter, HumanTag
from framewright.operators.dedupe import ExactDedupe, FuzzyDedupe
from framewright.operators.detection import AestheticScore, Anonymize, ClipEmbed, EdgeWatermarkRemoval, NudeNet
from framewright.operators.scaling import ConvertFormat, CropToAspect, Downscale, Upscale
from framewright.operators.smart import SmartHumanFilter
from framewright.operators.tagging import AddTags, RemoveTags, RewriteTags
from framewright.plans import Abort, Operator, Workspace
from framewright.sources.save import Save

__all__ = [
    "Abort", "AddTags", "AestheticScore", "Anonymize", "Apply", "ClipEmbed", "Concat", "ConvertFormat", "CropToAspect", "Downscale", "EdgeWatermarkRemoval", "ExactDedupe", "Fail", "Filter", "FilterByAspectRatio",
    "FilterBySize", "Florence2Caption", "Florence2Task", "From", "FuzzyDedupe", "GPT4oCaption", "GeminiCaption", "Gemma3Caption", "HumanCaption", "HumanFilter", "HumanTag", "Info", "JoyCaptionAlphaOne", "JoyCaptionAlphaTwo",
    "LLMCaptionTransform", "LLMCaptionVariations", "LlamaCaption", "Load", "Map", "MapCaption", "MolmoCaption", "NudeNet", "Operator", "Passthrough", "QwenVLCaption", "RemoveTags", "RewriteTags", "Save", "Set", "SetCaption",
    "Shuffle", "Sleep", "SmartHumanFilter", "Sorted", "Take", "Upscale", "Workspace", "XGenMMCaption",
]
