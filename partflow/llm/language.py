"""Language identification by string kernels: n-gram presence, Nystrom landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_CHARS = 2000  # a text is judged in blocks of so many code points; all of them count
SPECTRUM = ((1, 512), (2, 2560), (3, 5120))  # n-gram length, places
PLACES = sum(n for _, n in SPECTRUM)
SAMPLE_DOCS, SAMPLE_BLOCKS = 400, 4  # what the classifier is fitted on at most: documents a language, first blocks a document
LANDMARKS = 40  # a language
RIDGE = 1e-3
ROWS = 256  # blocks a matrix product
FLOOR_TEXTS, FLOOR_SHARE = 200, 0.005  # training blocks a language whose beginnings set the floors; the share of them that ends the usual range
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")  # categories Lu, Ll, Lt, Lm and Lo; numbers such as Ⅷ, ½ and ① are no letters


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # normalised presence vectors, a row each
    weights: np.ndarray  # landmark kernel values to one score a language
    floors: np.ndarray  # least value of the best language that a text of 2**k code points needs, k from 0


def presence(blocks: list[str]) -> np.ndarray:
    """Normalised presence of hashed n-grams of one to three code points: rows whose products are blended-spectrum kernels."""
    out = np.zeros((len(blocks), PLACES), np.float32)
    for row, block in zip(out, blocks, strict=True):
        codes = np.frombuffer(block.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        at = 0
        key = np.zeros(len(codes), np.uint64)
        for n, places in SPECTRUM:
            if len(codes) >= n:
                key = key[: len(codes) - n + 1] * np.uint64(0x110001) + codes[n - 1 :]
                mixed = (key ^ (key >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
                row[at + ((mixed >> np.uint64(32)) % np.uint64(places)).astype(np.int64)] = 1
            at += places
    norm = np.sqrt(out.sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1)


def blocks_of(text: str) -> list[str]:
    return [text[i : i + BLOCK_CHARS] for i in range(0, len(text), BLOCK_CHARS)]


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Kernel ridge regression through landmarks: the first blocks of each language, up to the number given."""
    names = sorted(set(languages))
    taken: list[int] = []
    for name in names:
        taken += [i for i, x in enumerate(languages) if x == name][:landmarks]
    if not names:
        return LanguageModel([], np.zeros((0, PLACES), np.float32), np.zeros((0, 0), np.float32), np.zeros(0))
    marks = presence([texts[i] for i in taken])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.vstack([presence(texts[i : i + ROWS]) @ marks.T for i in range(0, len(texts), ROWS)]).astype(np.float64) @ root
    wanted = np.where(np.asarray(languages)[:, None] == np.asarray(names)[None, :], 1.0, -1.0)
    weight = np.sqrt(len(texts) / (len(names) * np.asarray([languages.count(n) for n in names])))[[names.index(x) for x in languages]]
    a = features * weight[:, None]
    solved = np.linalg.solve(a.T @ a + ridge * len(texts) * np.eye(a.shape[1]), a.T @ (wanted * weight[:, None]))
    model = LanguageModel(names, marks, (root @ solved).astype(np.float32), np.zeros(0))
    model.floors = _floors(model, [t for name in names for t in [x for x, g in zip(texts, languages, strict=True) if g == name][:FLOOR_TEXTS]])
    return model


def values_of(model: LanguageModel, blocks: list[str]) -> np.ndarray:
    """One-versus-rest values of blocks, a column a language."""
    return (presence(blocks) @ model.landmarks.T) @ model.weights


def _floors(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """For beginnings of 1, 2, 4 ... code points of the training texts: a tenth of the way from the median to the lowest
    usual best value, below that value. Short texts show little of a language, so each length has its own floor."""
    out = []
    for k in range(BLOCK_CHARS.bit_length()):
        best = np.concatenate([values_of(model, [t[: 1 << k] for t in texts[i : i + ROWS]]).max(axis=1) for i in range(0, len(texts), ROWS)])
        low, middle = np.quantile(best, [FLOOR_SHARE, 0.5])
        out.append(low - (middle - low) / 10)
    return np.asarray(out)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4. False for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn_languages(docs: DataFrame) -> LanguageModel:
    """Fit on a bounded sample of the labelled rows: for each language the 400 documents whose hashed id is smallest, the
    first 4 blocks of 2,000 code points of each. Held-out rows and rows without id, language, text or letter are not used."""
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= SAMPLE_DOCS)
    chosen = chosen.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), "__rank")
    found = usable.join(F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang")))
    last = F.least(F.lit(SAMPLE_BLOCKS - 1), F.floor((F.length("text") - 1) / BLOCK_CHARS).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("text"), i * BLOCK_CHARS + 1, F.lit(BLOCK_CHARS)))
    sample = found.filter(F.length("text") > 0).select("lang", "__rank", F.posexplode(parts).alias("at", "block")).collect()  # bounded, see above
    sample = [r for r in sorted(sample, key=lambda r: (r["__rank"], r["at"], r["lang"], r["block"])) if _LETTER.search(r["block"])]
    return fit([r["block"] for r in sample], [r["lang"] for r in sample])


def identify_languages(docs: DataFrame, model: LanguageModel, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns to keep, lang_pred and score of each row by its text alone; nothing else of the row is looked at.

    The whole text counts: the scores of its blocks are averaged by length. score is 0 to 1, from one-versus-rest values -1
    to 1 of the best language. A null text, a text without a letter, and every text under a model without languages are
    'und' with score 0. Ties go to the language first by name. `rejected` says that no language can be told: a null or
    letterless text, or a best value below the model's floor for texts of that length; a model without languages rejects
    nothing. Repeated rows are judged alike; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x places: of a fixed size for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            totals = np.zeros((len(texts), max(1, len(model.languages))))
            known = [bool(t and model.languages and _LETTER.search(t)) for t in texts]
            rows, parts = [], []

            def score(totals=totals, rows=rows, parts=parts) -> None:
                values = values_of(model, parts)
                np.add.at(totals, rows, values * np.asarray([len(p) for p in parts])[:, None])
                rows.clear()
                parts.clear()

            for i, text in enumerate(texts):
                if known[i]:
                    for at in range(0, len(text), BLOCK_CHARS):
                        rows.append(i)
                        parts.append(text[at : at + BLOCK_CHARS])
                        if len(parts) == ROWS:
                            score()
            if parts:
                score()
            best = totals.argmax(axis=1)
            names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            means = [totals[i, b] / len(texts[i]) if known[i] else 0.0 for i, b in enumerate(best)]
            rejected = [bool(model.languages) and (not known[i] or means[i] < model.floors[min(len(texts[i]).bit_length(), len(model.floors)) - 1]) for i in range(len(texts))]
            scores = [min(1.0, max(0.0, (m + 1) / 2)) if k else 0.0 for m, k in zip(means, known, strict=True)]
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")
