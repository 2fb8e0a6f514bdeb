"""Language identification by compression.

Every language has a zstandard raw-content dictionary: a bounded sample of
its labelled texts.  A text is compressed with each dictionary, block by
block; the language whose dictionary gives the smallest size wins.  Where the
runner-up is nearly as small (sizes are whole bytes, so short texts tie), the
sizes are taken again as sums over several smaller dictionaries of each
language, drawn from the same sample, which tells fractions of a byte.  A
prediction whose margin stays narrow is rejected.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import annotate, id_remainder

#: Labelled rows a language's dictionary is made of (those with the smallest id hashes), and characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 128, 2000
#: Characters of all dictionaries together: with many languages each has fewer samples.
TOTAL_CHARS = 16_000_000
#: Smaller dictionaries of a language for narrow texts.
DRAWS = 12
#: Bytes of text that are compressed at a time, so that a long text is not its own dictionary.
BLOCK_BYTES = 4096
LEVEL = 6
#: Margin (runner-up size over best size, less 1) below which sizes are measured again.
NARROW = 0.03
#: Least margin of an accepted prediction.
MARGIN = 0.005
UNKNOWN = "und"
#: More label values than this is an error: dictionaries are broadcast, so their number must be bounded.
MAX_LANGUAGES = 1000


def dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 held_out: tuple[int, int] = (4, 2)) -> dict[str, list[bytes]]:
    """Normalised sample texts of each learned language.

    Rows whose crc32(id) leaves ``held_out[1]`` modulo ``held_out[0]`` are
    never read, nor rows without a label, id or text.  The sample is
    chosen over ids and labels alone; the texts of the chosen rows are then
    fetched, at most TOTAL_CHARS characters.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"),
                       docs[text_col].cast("string").alias("text"))
    train = rows.where("doc_id is not null and lang is not null and text is not null").where(
        id_remainder(F.col("doc_id"), held_out[0]) != held_out[1])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = train.select("doc_id", "lang").withColumn("place", place).where(F.col("place") <= SAMPLE_DOCS)
    langs = {r["lang"] for r in train.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()}
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has over {MAX_LANGUAGES} values")
    most = max(1, min(SAMPLE_DOCS, TOTAL_CHARS // (SAMPLE_CHARS * max(1, len(langs)))))
    ids = docs.sparkSession.createDataFrame(
        sorted({(r["doc_id"],) for r in chosen.where(F.col("place") <= most).select("doc_id").collect()}), "doc_id long")
    texts = train.join(F.broadcast(ids), "doc_id").select(  # at most TOTAL_CHARS / SAMPLE_CHARS ids
        "doc_id", "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text")).distinct().collect()
    parts: dict[str, list[bytes]] = {lang: [] for lang in sorted(langs)}
    for r in sorted(texts, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        parts[r["lang"]].append(normalised(r["text"]))
    return parts


#: ASCII that is no letter becomes white space: symbols and digits tell nothing of a language.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def normalised(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def draws(texts: list[bytes]) -> list[list[bytes]]:
    """Every DRAWS-th text from the first, from the second, ...: parts of a language's sample."""
    return [texts[i::DRAWS] for i in range(min(DRAWS, len(texts)))] or [texts]


def compressor(texts: list[bytes]) -> zstandard.ZstdCompressor:
    """One that has the texts as its dictionary (which must have 8 bytes)."""
    data = zstandard.ZstdCompressionDict(b" ".join(texts).ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


class Classifier:
    def __init__(self, samples: dict[str, list[bytes]]) -> None:
        self.of = [(lang, [compressor(texts)]) for lang, texts in sorted(samples.items())]
        self.drawn = [(lang, [compressor(draw) for draw in draws(texts)]) for lang, texts in sorted(samples.items())]

    @staticmethod
    def _sizes(blocks: list[bytes], of: list[tuple[str, list[zstandard.ZstdCompressor]]]) -> list[tuple[float, str]]:
        """Mean size of the blocks with a language's dictionaries, smallest first."""
        return sorted((sum(len(c.compress(b)) for b in blocks for c in own) / len(own), lang) for lang, own in of)

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); ties go to the language that sorts first."""
        if not text or not self.of or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        raw = normalised(text) or text.encode("utf-8", "surrogatepass")
        blocks = [raw[i:i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        sizes = self._sizes(blocks, self.of)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0
        if sizes[1][0] < sizes[0][0] * (1 + NARROW):
            sizes = self._sizes(blocks, self.drawn)
        (best, lang), (second, _) = sizes[:2]
        return lang, second / (best + second), second / best - 1


def detect(df: DataFrame, dicts: dict[str, list[bytes]], text_col: str = "text", margin: float = MARGIN,
           prefix: str = "lang_") -> DataFrame:
    """Every column of ``df`` and ``lang_pred``, ``lang_score`` (0 to 1), ``lang_margin``, ``lang_rejected``.

    Columns of ``df`` that have one of these names are replaced; ``prefix``
    gives others.

    ``und`` for a null or empty text, one without a letter, or when no
    language was learned; those are rejected.  Texts are read whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(dicts)
    fields = [(f"{prefix}pred", "string", pa.string()), (f"{prefix}score", "double", pa.float64()),
              (f"{prefix}margin", "double", pa.float64())]
    out = annotate(df, text_col, fields, lambda: Classifier(shared.value).classify)
    return out.withColumn(f"{prefix}rejected", (F.col(f"{prefix}pred") == UNKNOWN) | (F.col(f"{prefix}margin") < margin))
