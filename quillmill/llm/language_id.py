"""Language identification with string kernels.

A text's blended spectrum is the set of its byte n-grams of lengths 1 to 4 (ASCII letters in lower case, other
ASCII characters as blanks), hashed into `SLOTS` slots. The kernel of two texts is the number of n-grams present in both, over the
geometric mean of their set sizes. `LANDMARKS` training texts stand for the kernel's feature space (Nyström); on these
features kernel ridge regression is solved once for all languages, one against the rest. Scoring a batch is two matrix
products: presence by landmarks, and features by weights.

The classifier is fitted on a bounded sample of labelled rows: `SAMPLE` texts in all, dealt evenly over the languages, at most
`per_language` and at least `LEAST` for each, in the order of a seeded hash. Tasks turn the sample's whole texts into presence
vectors, of which the driver gets two kilobytes each, however long the texts are. There is a landmark for each language at
least. All texts are predicted, over their whole length.

Edge cases: a text that is null or has no letter is `und` with score 0. Rows with a null label or a null text are not
learned from. With no labelled rows every text is `und`; with one language that one is predicted. Ties go to the first
language in order. Repeated rows get equal predictions. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.storage import small_batches, tidy
from quillmill.llm.words import U, chunks_of

#: Slots of the presence vectors, the longest n-gram, and the number of landmarks.
SLOTS, LONGEST, LANDMARKS = 1 << 14, 4, 192
RIDGE = 1e-3
#: Texts of the training sample in all, and of each language at least.
SAMPLE, LEAST = 8192, 4
UNDETERMINED = "und"
_SEEDS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


_TABLE = np.full(256, 0x20, np.uint8)
for _c in [*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]:
    _TABLE[_c] = _c
for _c in range(ord("A"), ord("Z") + 1):
    _TABLE[_c] = _c + 32


def presence(raw: bytes) -> np.ndarray:
    """Which slots the text's n-grams fall into. ASCII letters in lower case and all bytes of other characters count."""
    x = _TABLE[np.frombuffer(raw, np.uint8)]
    blank = x == 0x20
    keep = np.ones(len(x), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    x = np.concatenate([[0x20], x[keep], [0x20]]).astype(np.uint32)
    out = np.zeros(SLOTS, bool)
    gram = x.copy()
    for n in range(1, LONGEST + 1):
        if n > 1:
            if len(gram) < 2:
                break
            gram = (gram[:-1] << np.uint32(8)) | x[n - 1 :]
        h = (gram.astype(U) + U(n << 40)) * _SEEDS[n - 1]
        out[(h >> U(50)).astype(np.int64)] = True
    return out


@dataclass
class Model:
    """presence (float32) @ landmarks -> common n-grams; normalised by sizes; @ weights -> a value for each language."""

    languages: list[str]
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    def look(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each language, and how much more of a text's n-grams the landmark nearest to it has than chance gives it:
        about 0 for a text in none of the languages, whatever its length, and 1 if all are there."""
        size = np.maximum(found.sum(1), 1)[:, None]
        common = found.astype(np.float32) @ self.landmarks
        kernel = common / np.sqrt(size * self.sizes[None, :])
        chance = self.sizes[None, :] / SLOTS
        return kernel @ self.weights[:-1] + self.weights[-1], ((common / size - chance) / (1 - chance + 1e-6)).max(1)

    def decide(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and a score in 0 to 1 from the values by a softmax."""
        odds = np.exp(4 * (values - values.max(1, keepdims=True)))
        return values.argmax(1), 1 / odds.sum(1)


def fit(found: np.ndarray, labels: list[str]) -> Model | None:
    """From the bit-packed presence vectors of a bounded sample, in seeded order."""
    languages = sorted(set(labels))
    if not languages:
        return None
    label = np.searchsorted(languages, labels)
    # Landmarks: the languages in turn, so that each has its share.
    turn: dict[str, int] = {}
    order = sorted(range(len(labels)), key=lambda i: (turn.setdefault(labels[i], 0), turn.update({labels[i]: turn[labels[i]] + 1}))[0])
    unpack = lambda rows: np.unpackbits(rows, axis=1).astype(np.float32)
    marks = unpack(found[order[: max(LANDMARKS, len(languages))]])
    sizes = np.maximum(marks.sum(1), 1)
    blocks = (unpack(found[i : i + 256]) for i in range(0, len(found), 256))
    cross = np.vstack([(x @ marks.T) / np.sqrt(np.maximum(x.sum(1), 1)[:, None] * sizes[None, :]) for x in blocks])
    within = (marks @ marks.T) / np.sqrt(sizes[:, None] * sizes[None, :])
    # Nyström: features are cross @ within^(-1/2); ridge on these features, folded back into weights on the kernel values.
    power, vectors = np.linalg.eigh(within.astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(power, 1e-6))) @ vectors.T
    features = np.hstack([cross @ root, np.ones((len(labels), 1))])
    count = np.bincount(label)  # languages weigh alike
    weight = len(labels) / (len(languages) * count[label])
    gram = features.T @ (features * weight[:, None]) + RIDGE * len(labels) * np.diag([1.0] * len(marks) + [0.0])
    weighted = features * weight[:, None]
    goals = np.stack([2 * weighted[label == k].sum(0) for k in range(len(languages))], axis=1) - weighted.sum(0)[:, None]
    solved = np.linalg.solve(gram + 1e-9 * np.eye(len(gram)), goals)
    weights = np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32)
    return Model(languages, np.ascontiguousarray(marks.T), sizes.astype(np.float32), weights)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Presence vectors, 8 slots a byte, of the texts that have a letter."""
    for batch in chunks_of(batches):
        lettered = [i for i, t in enumerate(batch.column("text")) if has_letter(t.as_py())]
        rows = batch.take(pa.array(lettered, pa.int64()))
        vectors = pa.array([np.packbits(presence(t.as_py().encode())).tobytes() for t in rows.column("text")], pa.binary())
        yield pa.RecordBatch.from_pydict({"lang": rows.column("lang"), "rank": rows.column("rank"), "found": vectors})


def sample_texts(docs: DataFrame, usable: Column, per_language: int = 512, seed: int = 7) -> DataFrame:
    """lang, rank and text of a bounded number of distinct texts of each language, by a seeded hash of the text: the same on each run.

    The numbers of distinct text hashes give each language a share of the hash range that holds about four times as many
    texts as wanted, so that only hashes of few texts are ranked, and only texts in the sample leave the scan. Copies of
    a text count once, in the shares too: the wanted number of distinct texts is chosen wherever there are as many.
    """
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = rows.withColumn("hash", F.xxhash64(F.lit(seed), "text"))
    counts = hashed.groupBy("lang", "hash").agg(F.lit(1)).groupBy("lang").count().collect()  # a row for each language
    wanted = max(LEAST, min(per_language, SAMPLE // max(1, len(counts))))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4.0 * wanted / r["count"])) for r in counts], "lang string, share double")
    place = F.pmod("hash", F.lit(1 << 40))
    placed = hashed.withColumn("place", place).join(F.broadcast(shares), "lang").filter(F.col("place") < F.col("share") * float(1 << 40))
    first = Window.partitionBy("lang").orderBy("place", "hash")
    chosen = placed.select("lang", "place", "hash").distinct().withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= wanted).drop("place")
    # Two numbers for each text of the sample are broadcast.
    return placed.join(F.broadcast(chosen), ["lang", "hash"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))


def training_sample(docs: DataFrame, usable: Column, per_language: int = 512, seed: int = 7) -> tuple[np.ndarray, list[str]]:
    """The bit-packed presence vectors of the sample's texts, and their languages."""
    found = sample_texts(docs, usable, per_language, seed).mapInArrow(tidy(_packed), "lang string, rank int, found binary")
    listed = sorted(found.collect(), key=lambda r: (r["rank"], r["lang"]))
    return np.frombuffer(b"".join(r["found"] for r in listed), np.uint8).reshape(-1, SLOTS // 8), [r["lang"] for r in listed]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _predict(model: Model | None, keep: float | None = None):
    """Rows with their prediction in place of the text; or, with `keep`, the rows in a language: with a letter, and with more than
    `keep` of its n-grams in common with a landmark if there is a model, whose prediction is their `lang`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks_of(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, min(256, batch.num_rows - at))
                texts = part.column("text").to_pylist()
                langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                known = np.array([i for i, t in enumerate(texts) if has_letter(t)], np.int64)
                if model and len(known):
                    values, common = model.look(np.stack([presence(texts[i].encode()) for i in known]))
                    best, score = model.decide(values)
                    for i, b, s in zip(known, best, score, strict=True):
                        langs[i], scores[i] = model.languages[b], float(s)
                    known = known[common > keep] if keep is not None else known
                if keep is not None:
                    kept = part.take(pa.array(known))
                    field = part.schema.field("lang")
                    yield kept.set_column(part.schema.names.index("lang"), field, pa.array([langs[i] for i in known], field.type)) if model else kept
                    continue
                rest = {n: part.column(n) for n in part.schema.names if n != "text"}
                yield pa.RecordBatch.from_pydict(rest | {"lang_pred": pa.array(langs), "score": pa.array(scores)})

    return run


def predict_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of each document; only the text is looked at."""
    return docs.select("doc_id", "text").mapInArrow(tidy(_predict(model)), "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents that aren't held out, predict all: doc_id, held_out, lang_pred, score."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(*training_sample(slim, ~held_out()))
    return predict_language(slim, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def drop_undetermined(docs: DataFrame, reject: float | None = None) -> DataFrame:
    """The documents for which the classifier gives a language, which is their `lang` from then on, whatever label they had.
    By default only those go whose prediction is `und`: without a text, or without a letter in it; a text in a language that
    it hasn't learned has a prediction and stays. Without labels to learn from `lang` stays as it is.

    With `reject`, from 0 to 1, texts go too whose share of n-grams beyond chance in common with the nearest landmark is not over it: most
    texts in another script have about 0, texts in a learned language 0.5 and more. This loses texts in languages of which
    no labels were given. Each row is judged by its own text, whatever its doc_id; without labels to learn from, a text
    with a letter stays in either case.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(*training_sample(slim, ~held_out()))
    return docs.mapInArrow(tidy(_predict(model, keep=-math.inf if reject is None else reject)), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
