"""Text to vectors through a pluggable encoder."""

import hashlib
import sys
import types
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread


class HashedTokenEncoder:
    """Deterministic stand-in for a sentence encoder: signed token hashes, L2-normalised."""

    model_name = "hashed-token"

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._slot = lru_cache(maxsize=1 << 18)(self._place)

    def _place(self, token):
        digest = hashlib.md5(token.encode("utf-8")).hexdigest()
        sign = 1.0 if int(digest[8], 16) < 8 else -1.0
        return int(digest[:8], 16) % self.dim, sign

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            for token, times in Counter(text.split()).items():
                slot, sign = self._slot(token)
                out[row, slot] += sign * times
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0).astype(np.float32)


def per_worker(key: str, make):
    """What ``make()`` returns, built once per Python worker and key and shared by its tasks."""
    module = sys.modules.setdefault("_catalogweave_encoders", types.ModuleType("_catalogweave_encoders"))
    if key not in module.__dict__:
        module.__dict__[key] = make()
    return module.__dict__[key]


def embed_texts(
    texts: DataFrame, make_encoder=HashedTokenEncoder, id_column: str = "fic_id", text_column: str = "summary"
) -> DataFrame:
    """(fic_id, embedding) for each non-NULL text.

    ``make_encoder`` is called once per Python worker and returns a callable from a list of
    texts to a float matrix, so a model is loaded once, not per task or batch. Factories are
    told apart by their pickled code and arguments.
    """
    key = hashlib.sha256(cloudpickle.dumps(make_encoder)).hexdigest()

    def encode(batches):
        encoder = per_worker(key, make_encoder)
        for batch in batches:
            if not len(batch):
                continue
            matrix = np.asarray(encoder(batch.column("text").to_pylist()), dtype=np.float32)
            offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("fic_id"), vectors], ["fic_id", "embedding"])

    present = texts.where(F.col(text_column).isNotNull()).select(
        F.col(id_column).cast("bigint").alias("fic_id"), F.col(text_column).alias("text")
    )
    return spread(present).mapInArrow(encode, "fic_id bigint, embedding array<float>")
