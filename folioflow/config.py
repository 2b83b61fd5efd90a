"""Typed configuration with defaults, file overlay and retrieval variants (driver side)."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field, fields
from typing import Any, get_type_hints


@dataclass(frozen=True)
class Paths:
    data_root: str = "data"
    crops_dir: str = "data/crops"
    regions_dir: str = "data/regions"
    chunks_path: str = "data/chunks"
    index_path: str = "data/index"
    kg_path: str = "data/kg"
    qa_path: str = "data/qa"
    results_dir: str = "data/results"


@dataclass(frozen=True)
class Ingest:
    source: str = "webdataset"
    shard_urls: tuple[str, ...] = ()
    coco_annotations: str = ""
    coco_image_dir: str = ""
    max_pages: int = 0
    streaming: bool = False


@dataclass(frozen=True)
class Models:
    text_embed_dim: int = 1024
    image_embed_dim: int = 768
    llm_max_new_tokens: int = 512
    providers: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Chunking:
    max_chars: int = 1200
    overlap_chars: int = 150
    min_chars: int = 40


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    candidate_k: int = 30
    use_sparse: bool = False
    use_image: bool = False
    use_graph: bool = False
    use_rerank: bool = False
    graph_hops: int = 1
    rrf_k: int = 60
    #: Constant of the store's own fusion of its dense and sparse lists, which counts ranks from 0.
    hybrid_rrf_k: int = 2
    text_weight: float = 1.0
    image_weight: float = 1.0
    graph_weight: float = 1.0


@dataclass(frozen=True)
class KnowledgeGraph:
    entity_labels: tuple[str, ...] = ("method", "dataset", "metric", "result", "author", "task", "model")
    ner_threshold: float = 0.5
    use_llm_relations: bool = True
    max_relation_chunks: int = 0
    cooccurrence: bool = True
    checkpoint_every: int = 200


@dataclass(frozen=True)
class Generation:
    temperature: float = 0.1
    max_context_items: int = 6
    max_images: int = 4
    chain_of_thought: bool = True
    vision_generation: bool = False


@dataclass(frozen=True)
class Evaluation:
    num_questions: int = 300
    num_visual_questions: int = 100
    num_multihop_questions: int = 100
    caption_sample_size: int = 500
    ks: tuple[int, ...] = (1, 3, 5, 10)
    use_llm_judge: bool = True
    judge_sample_size: int = 50
    seed: int = 42


@dataclass(frozen=True)
class Config:
    mode: str = "baseline"
    paths: Paths = field(default_factory=Paths)
    ingest: Ingest = field(default_factory=Ingest)
    models: Models = field(default_factory=Models)
    chunk: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    kg: KnowledgeGraph = field(default_factory=KnowledgeGraph)
    generation: Generation = field(default_factory=Generation)
    eval: Evaluation = field(default_factory=Evaluation)


#: Each variant's retrieval flags; an ablation turns on exactly one of the four.
VARIANTS: dict[str, dict[str, Any]] = {
    "baseline": {},
    "enhanced": {"use_sparse": True, "use_image": True, "use_graph": True, "use_rerank": True},
    "abl_hybrid": {"use_sparse": True},
    "abl_image": {"use_image": True},
    "abl_graph": {"use_graph": True},
    "abl_rerank": {"use_rerank": True},
}


def merge(base: dict, overlay: dict) -> dict:
    """Overlay one nested mapping on another: mappings merge, everything else is replaced; inputs stay as they are."""
    out = dict(base)
    for key, value in overlay.items():
        nested = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merge(out[key], value) if nested else value
    return out


def _build(kind: type, values: dict) -> Any:
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"{kind.__name__} has no field {', '.join(sorted(unknown))}")
    hints, made = get_type_hints(kind), {}
    for name, value in values.items():
        hint = hints[name]
        if dataclasses.is_dataclass(hint):
            made[name] = _build(hint, value or {})
        elif isinstance(value, list):
            made[name] = tuple(value)
        elif hint is float and isinstance(value, int) and not isinstance(value, bool):
            made[name] = float(value)
        elif hint in (bool, int, str, float) and (not isinstance(value, hint) or isinstance(value, bool) and hint is int):
            raise ValueError(f"{kind.__name__}.{name} must be {hint.__name__}")
        else:
            made[name] = value
    return kind(**made)


def from_dict(values: dict) -> Config:
    return _build(Config, values)


def read_mapping(path: str) -> dict:
    """A YAML or JSON file's mapping; YAML needs the yaml package."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def load(base_path: str, variant_path: str | None = None) -> Config:
    values = read_mapping(base_path)
    return from_dict(merge(values, read_mapping(variant_path)) if variant_path else values)


def variant(config: Config, name: str) -> Config:
    """``config`` with the flags of a named variant, and no others, turned on."""
    off = dict.fromkeys(("use_sparse", "use_image", "use_graph", "use_rerank"), False)
    return dataclasses.replace(config, mode=name, retrieval=dataclasses.replace(config.retrieval, **(off | VARIANTS[name])))
