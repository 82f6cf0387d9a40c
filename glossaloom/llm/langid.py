"""Language identification by string kernels.

Two texts are compared by their shared character n-grams: k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), where G holds the
distinct 1- to 3-grams of a text (blended spectrum, presence).  Nyström landmarks of every language span the kernel space,
one-versus-rest kernel ridge regression is fitted in it, and documents are scored in blocks by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaloom.llm.batches import output, slices, texts_of, written

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
_BLANK = 32
#: Documents multiplied at once.
_BLOCK = 64


@cache
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else a blank."""
    return np.fromiter((c if chr(c).isalpha() else _BLANK for c in range(0x110000)), np.int64, 0x110000)


def grams(text: str) -> np.ndarray:
    """Sorted distinct n-grams of a text as integers; letters in lower case, all else one blank.  Empty without letters."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    blank = codes == _BLANK
    if blank.all():
        return np.zeros(0, np.int64)
    codes = codes[~(blank & np.concatenate([[True], blank[:-1]]))]
    runs, found = codes, [codes]
    for order in ORDERS[1:]:
        runs = runs[:-1] << 21 | codes[order - 1 :]
        found.append(runs)
    return np.unique(np.concatenate(found))


def _places(vocabulary: np.ndarray, found: np.ndarray) -> np.ndarray:
    at = np.searchsorted(vocabulary, found)
    at[at == len(vocabulary)] = 0
    return at[vocabulary[at] == found] if len(vocabulary) else at[:0]


def _presence(vocabulary: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    rows = np.zeros((len(sets), len(vocabulary)), np.float32)
    for row, found in zip(rows, sets):
        row[_places(vocabulary, found)] = 1
    return rows


@dataclass
class LanguageModel:
    """Languages, the landmarks' n-grams and, for each n-gram and language, the weight that the kernel expansion gives it."""

    languages: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One-versus-rest values (texts x languages), about -1 to 1, and which texts have a letter."""
        sets = [grams(t) for t in texts]
        sizes = np.asarray([len(s) for s in sets], np.float32)
        values = [_presence(self.vocabulary, sets[i : i + _BLOCK]) @ self.weights for i in range(0, len(sets), _BLOCK)]
        return np.concatenate(values) / np.sqrt(np.maximum(sizes, 1))[:, None], sizes > 0

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        margins, lettered = self.margins(texts)
        best = margins.argmax(axis=1)
        scores = np.clip((1 + margins[np.arange(len(texts)), best].astype(np.float64)) / 2, 0, 1)
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)], np.where(lettered, scores, 0.0)


def _sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int) -> DataFrame:
    """About ``rows`` rows of each language, chosen by a hash of the id, ranked within the language."""
    known = labelled.where(F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not counts:
        return known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.lit(1).alias("rank")).limit(0)
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("landmarks")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, rows / n)))
    drawn = known.where((place < share[F.col(lang_col)]) & F.col(text_col).rlike(r"\p{L}"))
    order = "row_number() over (partition by lang order by place, text)"
    return drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place")).selectExpr("lang", "text", f"{order} as rank")


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 400, landmarks: int = 24,
    ridge: float = 1e-4,
) -> LanguageModel:
    """Fit on about ``rows`` hash-chosen rows a language (all rows if it has fewer), ``landmarks`` of them spanning the kernel.

    Rows with null language or without a letter teach nothing; without any other row the model finds every text
    undetermined.  The sample is the one bound here; what reaches the driver is the landmarks and one normal matrix a task.
    """
    sample = written(_sample(labelled, id_col, text_col, lang_col, rows), "landmarks")
    chosen = sorted(sample.where(F.col("rank") <= landmarks).select("lang", "text").collect())
    languages = sorted({r.lang for r in chosen})
    if not languages:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    sets = [grams(r.text) for r in chosen]
    vocabulary = np.unique(np.concatenate(sets))
    scaled = _presence(vocabulary, sets).T / np.sqrt([len(s) for s in sets]).astype(np.float32)
    shared = sample.sparkSession.sparkContext.broadcast((vocabulary, scaled, languages))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, scaled, languages = shared.value
        left = np.zeros((scaled.shape[1],) * 2)
        right = np.zeros((scaled.shape[1], len(languages)))
        rows = 0
        for batch in slices(batches, "text"):
            found = [grams(t) for t in texts_of(batch, "text")]
            kernel = (_presence(vocabulary, found) @ scaled / np.sqrt([[len(f)] for f in found])).astype(np.float64)
            wanted = np.asarray([[1.0 if lang == known else -1.0 for known in languages] for lang in batch.column("lang").to_pylist()])
            left += kernel.T @ kernel
            right += kernel.T @ wanted
            rows += len(found)
        made = [pa.array([v.reshape(-1).tolist()]) for v in (left, right)]
        yield pa.RecordBatch.from_arrays([*made, pa.array([rows], pa.int64())], names=["a", "b", "rows"])

    parts = sample.select("lang", "text").repartition(8).mapInArrow(normal, "a array<double>, b array<double>, rows long").collect()
    left = sum(np.asarray(p.a).reshape(len(sets), -1) for p in parts)
    right = sum(np.asarray(p.b).reshape(len(sets), -1) for p in parts)
    among = scaled.T.astype(np.float64) @ scaled
    count = sum(p.rows for p in parts)
    expansion = np.linalg.solve(left + ridge * count * among + 1e-9 * count * np.eye(len(sets)), right)
    return LanguageModel(languages, vocabulary, (scaled @ expansion).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row, repeated rows included; only the text decides.

    ``und`` with score 0 where the text is null or has no letter (or the model knows no language); equal margins go to the
    first language in order.  Nothing is shuffled.
    """
    schema = output(docs, id_col, ("lang_pred", "string"), ("score", "double"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, scores = shared.value.predict(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.string()), pa.array(scores)], names=schema.fieldNames())

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(apply, schema)
