"""One interface for features of texts, images and recordings: ``fit``, ``transform``, ``fit_transform`` and ``extract``."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillhawk.functions import media
from quillhawk.operators import tfidf


class Extractor(ABC):
    """``transform`` gives features per item, ``extract`` one row per single feature; ``fit`` may learn from the items."""

    def fit(self, df: DataFrame) -> Extractor:
        return self

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def extract(self, df: DataFrame) -> DataFrame:
        return self.transform(df)


class TfidfExtractor(Extractor):
    """(id, term, idx, weight) of texts. Asking an extractor that wasn't fitted is an error."""

    def __init__(self, id_col: str, text_col: str, how: tfidf.Preprocess = tfidf.Preprocess(), max_features: int | None = None) -> None:
        self.id_col, self.text_col, self.how, self.max_features = id_col, text_col, how, max_features
        self.model: tfidf.TfidfModel | None = None

    def _counts(self, df: DataFrame) -> DataFrame:
        return tfidf.term_frequency(df, self.id_col, self.text_col, self.how)

    def fit(self, df: DataFrame) -> TfidfExtractor:
        self.model = tfidf.fit_tfidf(self._counts(df), df.count(), self.id_col, self.max_features)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("the extractor is not fitted")
        return self.model.transform(self._counts(df), self.id_col)

    def feature_names(self) -> list[str]:
        """The vocabulary in order of its index; as long as the vocabulary."""
        if self.model is None:
            raise ValueError("the extractor is not fitted")
        return [r.term for r in self.model.feature_names().toLocalIterator()]


def stacked(df: DataFrame, keys: list[str], arrays: str, name: str) -> DataFrame:
    """(keys..., position, name): the vectors of all items below one another; items without vectors fall out."""
    return df.select(*keys, F.posexplode(arrays).alias("position", name))


class FrameExtractor(Extractor):
    """Cepstral frames of windows (doc_id, chunk_id, content): ``frames`` per window, or one row per frame. Nothing is fitted."""

    def __init__(self, sample_rate: int = media.SAMPLE_RATE, n_mfcc: int = media.N_MFCC) -> None:
        self.sample_rate, self.n_mfcc = sample_rate, n_mfcc

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("doc_id", "chunk_id", media.mfcc_frames(F.col("content"), self.sample_rate, self.n_mfcc).alias("frames"))

    def extract(self, df: DataFrame) -> DataFrame:
        return stacked(self.transform(df), ["doc_id", "chunk_id"], "frames", "frame")


class DescriptorExtractor(Extractor):
    """Local descriptors of images (doc_id, height, width, data): ``descriptors`` per image, or one row per descriptor."""

    def __init__(self, detect: Callable[[np.ndarray], np.ndarray] = media.grid_descriptors, root: bool = True) -> None:
        self.detect, self.root = detect, root

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("doc_id", media.descriptors(F.col("height"), F.col("width"), F.col("data"), self.detect, self.root).alias("descriptors"))

    def extract(self, df: DataFrame) -> DataFrame:
        return stacked(self.transform(df), ["doc_id"], "descriptors", "descriptor")
