"""Settings from a mapping or the environment; the environment wins over a file."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from lodestone.errors import ConfigurationError
from lodestone.functions.text import as_bool
from lodestone.operators.assemble import Options
from lodestone.operators.profiles import FINAL_TOP_K, PROFILES, VECTOR_RECALL_K


@dataclass(frozen=True)
class Config:
    index_path: str = "index"
    embedding_backend: str = "deterministic"
    embedding_model: str = ""
    enable_reranker: bool = False
    retrieval_profile: str = "evidence"
    vector_recall_k: int = VECTOR_RECALL_K
    final_top_k: int = FINAL_TOP_K
    batch_size: int = 20
    resume_chunks: int = 1_000_000
    options: Options = field(default_factory=Options)

    def __post_init__(self):
        if self.retrieval_profile not in {"evidence", *PROFILES}:
            raise ConfigurationError(f"unknown profile: {self.retrieval_profile}")
        for name in ("vector_recall_k", "final_top_k", "batch_size", "resume_chunks"):
            if type(getattr(self, name)) is not int or getattr(self, name) < 1:
                raise ConfigurationError(f"{name} must be a positive integer")

    @classmethod
    def from_file(cls, path: str) -> Config:
        """Settings of a file of NAME=value lines (blank lines and # comments between), under those of the environment."""
        values = {}
        with open(path, encoding="utf-8") as lines:
            for line in map(str.strip, lines):
                name, sign, value = line.removeprefix("export ").partition("=")
                if line and not line.startswith("#"):
                    if not sign:
                        raise ConfigurationError(f"not a setting: {line}")
                    value = value.strip()
                    values[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
        return cls.load(values)

    @classmethod
    def load(cls, values: Mapping[str, str] | None = None) -> Config:
        given = {**(values or {}), **os.environ}
        try:
            options = Options(**{f.name: type(f.default)(given.get(f"EVIDENCE_{f.name.upper()}", f.default)) for f in fields(Options)})
            numbers = {n: int(given.get(k, d)) for n, k, d in (("vector_recall_k", "VECTOR_RECALL_K", VECTOR_RECALL_K), ("final_top_k", "FINAL_TOP_K", FINAL_TOP_K), ("batch_size", "BUILD_BATCH_SIZE", 20))}
        except (TypeError, ValueError) as why:
            raise ConfigurationError(f"invalid settings: {why}") from why
        return cls(
            index_path=given.get("KB_PATH", "index"),
            embedding_backend=given.get("EMBEDDING_BACKEND", "deterministic"),
            embedding_model=given.get("EMBEDDING_MODEL", ""),
            enable_reranker=as_bool(given.get("ENABLE_CROSS_ENCODER")),
            retrieval_profile=given.get("RETRIEVAL_PROFILE", "evidence"),
            options=options,
            **numbers,
        )
