"""Settings: fixed defaults, and two readers of overrides. One falls back to the default, one throws (ORC-12)."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

from .operators.retrieve import Options
from .sources.files import exclude_patterns

PREFIX = "QUARRY_"

# Default, least, most, whole number, of the settings a user may change.
BOUNDS = {
    "retrieval_limit": (5, 1, 20, True), "retrieval_threshold": (0.5, 0, 1, False), "relevance_cut": (0, 0, 1, False), "context_share": (0.6, 0.1, 0.9, False),
    "lane_candidates": (50, 5, 200, True), "neighbour_chunks": (1, 0, 5, True), "rerank_depth": (10, 0, 50, True), "rrf_constant": (60, 1, 200, True),
    "bm25_k1": (1.2, 0, 3, False), "bm25_b": (0, 0, 1, False), "weight_vector": (1, 0, 5, False), "weight_hyde": (1, 0, 5, False),
    "weight_keyword": (1, 0, 5, False), "weight_date": (1, 0, 5, False), "draft_timeout_ms": (10_000, 1000, 60_000, True),
}
DEFAULT_MODEL = "nomic-ai/nomic-embed-text-v1.5-GGUF"
DEFAULT_TEMPLATE = "Use the following passages to answer the question, and say so if they don't hold the answer.\n\n{{rag_context}}\n\nQuestion: {{user_query}}"


@dataclass(frozen=True)
class Settings:
    documents_dir: str = ""
    store_dir: str = ""
    model: str = DEFAULT_MODEL
    exclude: tuple[str, ...] = ()
    template: str = DEFAULT_TEMPLATE
    reindex: str = "off"
    depth: str = "medium"
    chunk_size: int = 512
    chunk_overlap: int = 100
    enable_ocr: bool = True
    structured: bool = True
    retrieval_limit: int = 5
    retrieval_threshold: float = 0.5
    relevance_cut: float = 0.0
    context_share: float = 0.6
    lane_candidates: int = 50
    neighbour_chunks: int = 1
    rerank_depth: int = 10
    rrf_constant: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.0
    weight_vector: float = 1.0
    weight_hyde: float = 1.0
    weight_keyword: float = 1.0
    weight_date: float = 1.0
    draft_timeout_ms: int = 10_000

    def missing(self) -> list[str]:
        return [name for name, value in (("Documents Directory", self.documents_dir), ("Store Directory", self.store_dir)) if not value]

    def options(self) -> Options:
        weights = {k: getattr(self, f"weight_{k}") for k in ("vector", "hyde", "keyword", "date")}
        return Options(self.depth, self.retrieval_limit, self.retrieval_threshold, self.lane_candidates, self.rrf_constant, self.neighbour_chunks, self.rerank_depth, self.bm25_k1, self.bm25_b, weights)


FIXED_DEFAULTS = Settings()


def not_configured(missing: list[str]) -> str:
    return f"Retrieval is not in use: set {' and '.join(missing)} in the settings."


def advanced_number(value: Any, name: str) -> float:
    """A number within the bounds, rounded where it must be whole; anything else is the default."""
    default, least, most, whole = BOUNDS[name]
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or not least <= value <= most:
        return default
    return round(value) if whole else value


def resolve(config: Mapping[str, Any]) -> Settings:
    """Interactive settings: a value of the wrong kind is the default; advanced ones count only while `advanced` is on (SUB-25)."""
    text = lambda k: config[k] if isinstance(config.get(k), str) else ""
    own = {
        "documents_dir": text("documents_dir").strip(), "store_dir": text("store_dir").strip(), "model": text("model").strip() or DEFAULT_MODEL, "exclude": tuple(exclude_patterns(text("exclude"))),
        "template": text("template") if text("template").strip() else DEFAULT_TEMPLATE, "reindex": text("reindex") if text("reindex") in ("changed", "rebuild") else "off",
        "depth": text("depth") if text("depth") in ("low", "high") else "medium",
    }
    if config.get("advanced") is True:
        own |= {k: advanced_number(config.get(k), k) for k in BOUNDS}
    return replace(FIXED_DEFAULTS, **own)


def number(env: Mapping[str, str], name: str, default: float, least: float = -math.inf, most: float = math.inf, whole: bool = False) -> float:
    """A number of the environment, or an error that names the variable (SUB-26)."""
    raw = (env.get(PREFIX + name.upper()) or "").strip()
    if not raw:
        return default
    try:
        value = float(raw)
    except ValueError:
        value = math.nan
    if not math.isfinite(value) or not least <= value <= most or (whole and value != int(value)):
        kind = "a whole number" if whole else "a number"
        between = f" between {least:g} and {most:g}" if math.isfinite(most) else f" of at least {least:g}" if math.isfinite(least) else ""
        raise ValueError(f'{PREFIX}{name.upper()} must be {kind}{between}, got "{raw}"')
    return int(value) if whole else value


def evaluation_settings(env: Mapping[str, str]) -> Settings:
    """Settings of an evaluation run; a bad value is an error."""
    depth = (env.get(f"{PREFIX}RETRIEVAL_DEPTH") or "medium").strip().lower()
    if depth not in ("low", "medium", "high"):
        raise ValueError(f'{PREFIX}RETRIEVAL_DEPTH must be "low", "medium" or "high", got "{depth}"')
    own: dict[str, Any] = {"depth": depth, "retrieval_limit": number(env, "retrieval_limit", 5, 1, 20, True), "retrieval_threshold": number(env, "retrieval_threshold", 0.5, 0, 1), "chunk_size": number(env, "chunk_size", 512, 128, 2048, True)}
    own |= {k: number(env, k, BOUNDS[k][0], 0) for k in BOUNDS if k.startswith("weight_")}
    own |= {k: number(env, k, BOUNDS[k][0], whole=BOUNDS[k][3]) for k in ("lane_candidates", "neighbour_chunks", "rerank_depth", "bm25_k1", "bm25_b")}
    return replace(FIXED_DEFAULTS, **own)


def generation_settings(env: Mapping[str, str]) -> dict[str, float]:
    return {"count": number(env, "eval_count", 30, 1, whole=True), "seed": number(env, "eval_seed", 42, whole=True), "leak_limit": number(env, "eval_leak_limit", 0.7, 0, 1)}


def indexing_settings(env: Mapping[str, str]) -> Settings:
    """Settings of the index command: no bounds, and only `true` is true (SUB-27)."""
    flag = lambda name, default: env.get(PREFIX + name, str(default)).lower() == "true"
    amount = lambda name, default: int(float(env.get(PREFIX + name) or default))
    return replace(FIXED_DEFAULTS, chunk_size=amount("CHUNK_SIZE", 512), chunk_overlap=amount("CHUNK_OVERLAP", 100), enable_ocr=flag("ENABLE_OCR", True), structured=flag("STRUCTURED_INDEXING", True))


def as_applied(s: Settings) -> Settings:
    """What a depth makes of the settings: low fuses nothing, medium doesn't draft."""
    fusing, drafting = s.depth != "low", s.depth == "high"
    return replace(s, weight_hyde=s.weight_hyde * drafting, weight_keyword=s.weight_keyword * fusing, weight_date=s.weight_date * fusing, neighbour_chunks=s.neighbour_chunks * fusing)


def snapshot(s: Settings, manifest: dict | None, **more: Any) -> dict[str, Any]:
    """What an evaluation report records of the settings and the index."""
    applied = as_applied(s)
    return {f.name: getattr(applied, f.name) for f in fields(s)} | {"index_format": (manifest or {}).get("format", "legacy"), "manifest": manifest} | more


def resource_problems(disk_gb: float, memory_gb: float, lenient: bool = False) -> list[tuple[str, str]]:
    """(level, message) of too little disk or memory; lenient: too little memory is a warning only (ORC-13)."""
    out = []
    for what, have, least, wanted in (("disk space", disk_gb, 1, 10), ("memory", memory_gb, 0.5, 2)):
        if have < wanted:
            error = have < least and not (lenient and what == "memory")
            out.append(("error" if error else "warning", f"{have:.1f} GB of {what} free, {least if error else wanted:g} GB wanted"))
    return out
