"""One consistent form for text that looks the same."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.operators.materialise import materialise
from siltline.operators.skew import broadcast_if_small

#: Rows of one key that a task of a join takes.
PER_TASK = 20_000

#: Letters of other scripts with the shape of a Latin letter (fixed values): phonetic and Greek, Cyrillic, Armenian, Coptic, Lisu, Cherokee.
LOOK_ALIKES = {
    "ɑ": "a", "ɡ": "g", "Ϳ": "J", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "Ѵ": "V",
    "ѵ": "v", "Ү": "Y", "һ": "h", "Ӏ": "I", "ӏ": "l", "ԁ": "d", "Ԛ": "Q", "ԛ": "q", "Ԝ": "W", "ԝ": "w", "Օ": "O", "Տ": "S", "հ": "h", "ո": "n", "ս": "u", "օ": "o",
    "ց": "g", "զ": "q", "յ": "j", "Ս": "U",
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R",
    "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
#: Code points with the property Default_Ignorable_Code_Point, as first and last (fixed values).
IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Hyphens that print like the ASCII one (fixed values).
HYPHENS = "‐‑"


@lru_cache(maxsize=1)
def _shapes() -> dict[int, str | None]:
    """What each character is drawn like: its usual form, or None if it is not drawn."""
    table: dict[int, str | None] = {}
    for c in [*range(0xA0, 0x3400), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFF0)]:
        kind, _, rest = unicodedata.decomposition(chr(c)).partition(" ")
        if kind in ("<wide>", "<narrow>") or 0xFB00 <= c <= 0xFB06 or 0x2160 <= c <= 0x217F:
            # Joined letters, width variants and letter numerals are drawn as the letters they stand for.
            table[c] = unicodedata.normalize("NFKD", chr(c))
        elif unicodedata.category(chr(c)) == "Zs" and c != 0x1680:
            table[c] = " "
    table |= {ord(c): "-" for c in HYPHENS} | {ord(c): to for c, to in LOOK_ALIKES.items()}
    for first, last in IGNORABLE:
        table |= dict.fromkeys(range(first, last + 1))
    return table


def _drawn(text: str) -> str:
    return text.translate(_shapes())


def visual_form(text: str) -> str:
    """The text with every character that is drawn like a usual one replaced by that one.

    Accents are composed; invisible characters are gone; blanks, widths, joined letters and look-alike
    letters are unified. Case, digits, punctuation and line breaks stay. A line break is one character.
    """
    if "\r\n" in text:
        text = text.replace("\r\n", "\n")
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", _drawn(unicodedata.normalize("NFD", text)))


def canonical_form(text: str) -> str:
    """Compatibility normalisation, full case folding, mapped white space, no ignorable characters.

    Texts of equal visual form have equal canonical forms.
    """
    return _folded(visual_form(text))


def _folded(visual: str) -> str:
    """The canonical form of a text of this visual form."""
    if visual.isascii():
        return visual.lower()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", visual).casefold())
    return folded if folded.isascii() else unicodedata.normalize("NFC", _drawn(folded).casefold())


def visual_sql(text: str) -> str:
    """The visual form as an expression of a plain SQL engine that composes characters, out of the same table of shapes."""
    one: dict[str, str] = {}
    several: dict[str, str] = {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0xFFFF)]):
        seen = visual_form(c)
        if seen != unicodedata.normalize("NFC", c):
            (one if len(seen) == 1 else several)[c] = seen
    gone = [c for c, seen in several.items() if not seen]
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    # Characters without a partner in the second text are left out.
    out = f"translate(nfc_normalize(replace({text}, chr(13) || chr(10), chr(10))), {quoted(''.join([*one, *gone]))}, {quoted(''.join(one.values()))})"
    for c, seen in several.items():
        if seen:
            out = f"replace({out}, {quoted(c)}, {quoted(seen)})"
    return f"nfc_normalize(regexp_replace({out}, '[\\x{{1BCA0}}-\\x{{1BCA3}}\\x{{1D173}}-\\x{{1D17A}}\\x{{E0000}}-\\x{{E0FFF}}]', '', 'g'))"


def canonical_text(rows: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """The rows with the canonical form of a text column, each distinct value of a batch worked out once.

    Null stays null, empty text stays empty; a text of only invisible characters becomes empty; a column of
    the name ``out`` is replaced. Unpaired surrogates cannot occur in a Spark string.
    """
    return rows.withColumn(out, _by_value(canonical_form)(F.col(text)))


def _by_value(function):
    @F.arrow_udf("string")
    def apply(values: pa.Array) -> pa.Array:
        coded = values.dictionary_encode()
        distinct = pa.array([None if v is None else function(v) for v in coded.dictionary.to_pylist()], pa.string())
        return distinct.take(coded.indices)

    return apply


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def digests(rows: DataFrame, id: str, text: str) -> DataFrame:
    """Per row 128-bit digests: of the canonical form, of the visual form, and of the text itself. Null texts are left out."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("text").dictionary_encode()
            found = []
            for text_ in coded.dictionary.to_pylist():
                seen = visual_form(text_)
                own = _digest(text_)
                found.append((_digest(_folded(seen)), own if seen == text_ else _digest(seen), own))
            columns = [pa.array([f[n] for f in found], pa.binary()).take(coded.indices) for n in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "canonical", "visual", "exact"])

    base = rows.select(F.col(id).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return base.mapInArrow(stream, f"id {base.schema['id'].dataType.simpleString()}, canonical binary, visual binary, exact binary")


def look_alike_classes(rows: DataFrame, id: str, text: str) -> DataFrame:
    """The rows whose text looks like another, different text, each with its class.

    Texts meet by the digest of their canonical form. That form also merges what prints differently, as case or
    compatibility forms, so a digest of the visual form, which keeps these apart, decides which of them make a class.
    Copies of a text are added up before anything else, on the map side first.

    Returns the id, ``class_id`` (the least id of the class), ``text_id`` (the same for exactly equal texts), ``members`` (rows of the class) and ``links`` (rows of the class with another text).

    Null texts and null ids are in no class; empty text looks like text of only invisible characters; exact copies
    alone make no class; a repeated id counts as often as it occurs; other columns do not matter.
    """
    known = materialise(digests(rows.filter(F.col(id).isNotNull()), id, text))
    found = known.groupBy("canonical", "visual").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi"), F.count(F.lit(1)).alias("members"), F.min("id").alias("class_id"))
    several = found.filter(F.col("lo") != F.col("hi")).select("canonical", "visual", "class_id", "members", F.col("members").alias("rows"))
    # A class, and a text, may have a third of all rows; these are divided, and the one row that they meet is repeated.
    inside = materialise(spread_join(known, several, ["canonical", "visual"], "id").select("id", "exact", "class_id", "members"))
    copies = inside.groupBy("exact").agg(F.count(F.lit(1)).alias("rows")).withColumn("copies", F.col("rows"))
    out = spread_join(inside, copies, ["exact"], "id")
    return out.select(F.col("id").alias(id), "class_id", F.hex("exact").alias("text_id"), "members", (F.col("members") - F.col("copies")).alias("links"))


def spread_join(left: DataFrame, right: DataFrame, key: Sequence[str], by: str, per_task: int = PER_TASK) -> DataFrame:
    """An inner join in which the rows of one key are divided among tasks by a hash of ``by``.

    ``right`` says in ``rows`` how many rows of ``left`` a key has; it is repeated as often as that makes
    ``per_task`` rows. It is broadcast instead if it is counted to be small.
    """
    small = broadcast_if_small(right)
    if small is not right:
        return left.join(small.drop("rows"), list(key))
    parts = F.greatest(F.ceil(F.col("rows") / per_task), F.lit(1)).cast("int")
    sizes = right.groupBy(*key).agg(F.max(parts).alias("_parts")).filter(F.col("_parts") > 1)  # at most rows / per_task keys
    marked = left.join(broadcast_if_small(sizes), list(key), "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    return marked.join(right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("rows"), [*key, "_part"]).drop("_part")


def look_alike_pairs(rows: DataFrame, id: str, text: str) -> DataFrame:
    """Every pair of rows whose texts look the same although their characters differ, from the classes.

    Pairs are found between distinct texts of a class, and only these are expanded to rows. Exact copies among
    themselves are never paired or compared.

    Returns ``<id>_a`` < ``<id>_b``. Null texts and null ids take part in no pair; empty text looks like text
    of only invisible characters; a repeated id counts as often as it occurs; other columns do not matter.
    """
    classes = materialise(look_alike_classes(rows, id, text))
    texts = classes.groupBy("class_id", "text_id").agg(F.count(F.lit(1)).alias("copies"))
    a, b = texts.select("class_id", F.col("text_id").alias("x"), F.col("copies").alias("rows")), texts.select("class_id", F.col("text_id").alias("y"))
    pairs = a.join(b, "class_id").filter(F.col("x") < F.col("y")).select("x", "y", "rows")
    one = classes.select(F.col(id).alias("i"), F.col("text_id").alias("x"))
    two = classes.select(F.col(id).alias("j"), F.col("text_id").alias("y"), F.col("members").alias("rows"))
    both = spread_join(spread_join(one, pairs, ["x"], "i").select("i", "y"), two, ["y"], "i").filter(F.col("i") != F.col("j"))
    return both.select(F.least("i", "j").alias(f"{id}_a"), F.greatest("i", "j").alias(f"{id}_b"))
