"""Language identification by compression with per-language raw-content dictionaries.

For each language zstandard raw-content dictionaries hold text of that language; a text's language is the one
whose first dictionary compresses the whole text (its words, in lower case) to the fewest bytes. Where
the two best differ by `NARROW` bytes or less (zstandard stores very short texts as they are), the bytes that the text adds behind
pieces of each language's other dictionaries are added. The margin is the share of bytes saved over the runner-up, of
`ENOUGH` bytes at most (what a dictionary can save is bounded, so the whole text's share would shrink as it grows); the score is a logistic function
of it, and a text is rejected when it is too narrow.

Defined cases: texts that are null or without a letter are `und` with score 0; repeated rows get a row each;
with no labelled text every text is `und`; of languages that leave equally few bytes the first by name is taken. An empty table gives no rows.
Bytes that aren't UTF-8 are read as U+FFFD. Columns other than those named are passed over. One text is compressed whole, which takes three times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytewords as bw

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: a-z and the bytes of other characters stay, the rest become spaces
_TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: sizes in bytes of each language's dictionaries
BLOCKS = (65_536, 32_768, 32_768)
NARROW = 2
#: compressed bytes of the runner-up over which a margin is taken, at most
ENOUGH = 2000
#: A language is rejected below this score (0.5 is no margin at all, which no text is below).
NARROW_MARGIN = 0.52


def plain(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" "


def pieces_of(column: str, size: int):
    """A text cut into pieces of so many characters."""
    return F.regexp_extract_all(column, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def learn(documents: DataFrame, piece: int = 400, blocks: tuple[int, ...] = BLOCKS, language: str = "lang") -> dict[str, list[bytes]]:
    """Dictionary texts by language from labelled rows that are not held out.

    A bounded sample: whole texts are cut into pieces of `piece` characters, of which per language those with the least hashes
    are taken, each distinct one once, twice sum(`blocks`) / `piece` of them (so they fill `blocks` bytes if half of
    their bytes are letters). Every value of `lang` is learned, as it is; the model and what the driver collects hold sum(`blocks`) bytes for each
    of them, so they grow with the languages, not with the rows.
    """
    from tessera.llm.toxicity import held_out

    need = -(-2 * sum(blocks) // piece)
    labelled = documents.filter(F.col(language).isNotNull() & F.col("text").isNotNull() & ~held_out()).select(F.col(language).cast("string").alias("lang"), "text").filter("text <> ''")
    many = labelled.groupBy("lang").agg(F.sum(F.ceil(F.length("text") / piece)).alias("n")).collect()
    best: dict[str, list[str]] = {}
    share = {r["lang"]: min(1.0, 4 * need / r["n"]) for r in many}
    while share:  # again where copies leave too few distinct pieces
        below = F.create_map(*[F.lit(x) for lang, s in share.items() for x in (lang, s)])[F.col("lang")]
        each = labelled.select("lang", F.explode(pieces_of("text", piece)).alias("piece")).withColumn("h", F.xxhash64("piece"))
        each = each.filter(F.shiftrightunsigned("h", 11) < below * 2.0**53).groupBy("lang", "h").agg(F.min("piece").alias("piece"))
        least = each.selectExpr("*", "row_number() over (partition by lang order by h) as rank").filter(F.col("rank") <= need)
        found: dict[str, list] = {}
        for r in least.orderBy("lang", "rank").collect():  # `need` rows a language
            found.setdefault(r["lang"], []).append(r["piece"])
        best |= {lang: found.get(lang, []) for lang in share}
        share = {lang: min(1.0, 16 * s) for lang, s in share.items() if s < 1 and len(best[lang]) < need}
    out = {}
    for lang, rows in sorted(best.items()):
        raw = b" ".join(plain(t) for t in rows)
        at = np.concatenate(([0], np.cumsum(blocks)))
        part = min(1.0, len(raw) / at[-1])
        out[lang] = [raw[int(a * part) : int(b * part)] for a, b in zip(at, at[1:], strict=False)]
    return out


class Compressors:
    def __init__(self, blocks: dict[str, list[bytes]], level: int = 6):
        self.langs = sorted(blocks)
        options = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.each, self.heads = [], []
        for lang in self.langs:
            own = []
            for raw in blocks[lang]:
                d = zstandard.ZstdCompressionDict(raw or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=options)
                own.append(zstandard.ZstdCompressor(dict_data=d, compression_params=options).compress)
            self.each.append(own)
            heads = [(c, raw[k : k + 1500]) for c, raw in zip(own, blocks[lang], strict=True) for k in (0, 8000, 16000)]
            self.heads.append([(c, head, len(c(head))) for c, head in heads])

    def sizes(self, text: str) -> tuple[np.ndarray, int]:
        """Per language the bytes that are left, and the bytes of the text."""
        raw = plain(text)
        size = np.array([len(own[0](raw)) for own in self.each], float)
        if len(size) > 1 and np.diff(np.partition(size, 1)[:2])[0] <= NARROW:
            size += [sum(len(c(head + raw)) - alone for c, head, alone in more) for more in self.heads]
        return size, len(raw)

    def classify(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        size, n = self.sizes(text)
        order = np.argsort(size, kind="stable")
        if len(size) == 1:
            return self.langs[0], 1.0
        margin = (size[order[1]] - size[order[0]]) / min(size[order[1]], ENOUGH)
        return self.langs[order[0]], float(1 / (1 + np.exp(-margin * np.sqrt(min(n, 400)) * 2.0)))


def identify(documents: DataFrame, blocks: dict[str, list[bytes]], columns: list[str] | None = None, reject_below: float = NARROW_MARGIN) -> DataFrame:
    """The columns asked for (doc_id if none are named), lang_pred, score, rejected (und, or a score below `reject_below`)."""
    keep = columns or ["doc_id"]
    frame = documents.select(*dict.fromkeys([*keep, "text"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressors(blocks)
        for batch in batches:
            found = [c.classify(t) for t in bw.texts(batch.column("text"))]
            lang, score = [f[0] for f in found], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([a == UNKNOWN or s < reject_below for a, s in found], pa.bool_())], [*keep, "lang_pred", "score", "rejected"])

    return bw.arrow(frame, run, f"{fields}, lang_pred string, score double, rejected boolean")
