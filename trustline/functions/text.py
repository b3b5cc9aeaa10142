"""Words, ids and edit counts as column expressions; all of it runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is letters or digits of any script, with one inner apostrophe part at most.
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?"
# Words of a pair become characters from here on; up to the last code point there is room for a million distinct words.
FIRST_CHAR, MOST_WORDS = 0x10000, 0x100000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(text: str | Column) -> Column:
    """Lower-case words of a text in order; null and texts without a word give an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def edit_errors(ref: str | Column, hyp: str | Column) -> Column:
    """Fewest substitutions, insertions and deletions between two word arrays.

    Each pair's distinct words are mapped to single characters, so that the built-in edit distance counts words; looking a
    word up costs no more than its row of the distance. Pairs with more distinct words than there are characters, a million,
    raise an error. Null arrays count as empty."""
    ref, hyp = (F.coalesce(col(c), F.array().cast("array<string>")) for c in (ref, hyp))

    def coded(words: Column, vocab: Column) -> Column:
        return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.lit(FIRST_CHAR - 1).cast("bigint") + F.array_position(vocab, w)), 8, "0")), "UTF-32")), "")

    def distance(pair: Column) -> Column:
        edits = F.levenshtein(coded(pair["r"], pair["v"]), coded(pair["h"], pair["v"])).cast("bigint")
        return F.when(F.size(pair["v"]) <= MOST_WORDS, edits).otherwise(F.raise_error(F.lit("too many distinct words in one pair")).cast("bigint"))

    # An array of one binds the pair's vocabulary, which would be made again for every word otherwise.
    bound = F.array(F.struct(ref.alias("r"), hyp.alias("h"), F.array_distinct(F.concat(ref, hyp)).alias("v")))
    return F.get(F.transform(bound, distance), F.lit(0))


def accuracy(errors: str | Column, words: str | Column) -> Column:
    """max(0, 1 - errors / words); null without words."""
    return F.greatest(F.lit(0.0), 1 - F.try_divide(col(errors).cast("double"), col(words).cast("double")))


def non_empty(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(""))


# The forms of ids that hold a speaker or a recording.
SPEAKER_IN_ID = r"(?<!\d)(\d{4,5})(?!\d)"
RECORDING_IN_ID = (r"^(\d{5}_[A-Z]_\d{3})_", r"^(\d{5}_\d{2})_")


def derive_speaker_id(utt_id: str | Column, explicit: str | Column | None = None) -> Column:
    """The explicit speaker, else the id's first run of exactly four or five digits, padded to five, else null."""
    found = F.lpad(non_empty(F.regexp_extract(col(utt_id), SPEAKER_IN_ID, 1)), 5, "0")
    return found if explicit is None else F.coalesce(non_empty(explicit), found)


def derive_group_id(utt_id: str | Column, explicit: str | Column | None = None) -> Column:
    """The explicit recording, else the id's recording prefix in one of two forms, else the id."""
    u = col(utt_id)
    found = [non_empty(F.regexp_extract(u, p, 1)) for p in RECORDING_IN_ID]
    return F.coalesce(*([non_empty(explicit)] if explicit is not None else []), *found, u)


def seed_hash(utt_id: str | Column, seed: int, variant: int | Column = 0) -> Column:
    """32-bit seed of an utterance and variant: eight hex digits of its SHA-256, plus seed and 10**6 a variant."""
    base = F.conv(F.substring(F.sha2(col(utt_id).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    v = F.lit(variant) if isinstance(variant, int) else variant
    return (base + seed + v.cast("bigint") * 1_000_000) % (1 << 32)


def uniform(*parts: Column) -> Column:
    """A portable uniform number in [0, 1): 52 bits of the SHA-256 of the parts joined by colons."""
    digest = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
