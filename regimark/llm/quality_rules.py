"""Quality rules: base counts, and distribution divergence from language references.

Each text is read once for its counts and two histograms: character classes and common words. The language
references are the summed histograms of all texts that pass the base rules, one for each of a fixed list of
languages. A text is kept if it passes the base rules and both of its histograms lie within a Jensen-Shannon
distance of its language's reference; that of words is a share of the distance that a text without any common
word has there, so that it holds in every language and whatever the reference is summed over. Texts too short
for a histogram aren't judged by it.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, stored

# Common words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on with as by be this are was from or an at not have he".split(),
    "fr": "de la le les et des en un une du que qui est pour dans par sur au il pas plus ne se ce avec".split(),
    "de": "der die und den das von zu mit sich des auf ist im dem nicht ein eine als auch es an er so".split(),
    "es": "de la que el en y los se del las un por con una su para es al lo como pero sus le ha o".split(),
}
# The characters that rules count as symbols.
SYMBOLS = b"#*$%&|<>"

MAX_CLASS_DISTANCE = 0.28
#: Of the distance that a text without common words has to its language's reference.
MAX_WORD_SHARE = 0.88
MIN_WORDS_FOR_HISTOGRAM = 70
SPACE = b" \t\n\x0b\x0c\r"

LOWER, UPPER, DIGIT, BLANK, STOP, MARK, SYMBOL, OTHER, LETTER, SKIP = range(10)
CLASSES = 9


def _class_table() -> bytes:
    """Class of each UTF-8 byte: later bytes of a character are skipped, first ones count as letters."""
    of = bytearray([OTHER] * 256)
    for b in range(256):
        c = bytes([b])
        if c.islower():
            of[b] = LOWER
        elif c.isupper():
            of[b] = UPPER
        elif c.isdigit():
            of[b] = DIGIT
        elif c in SPACE:
            of[b] = BLANK
        elif c in b".,":
            of[b] = STOP
        elif c in b";:!?'\"()-":
            of[b] = MARK
        elif c in SYMBOLS:
            of[b] = SYMBOL
        elif b >= 0xC0:
            of[b] = LETTER
        elif b >= 0x80:
            of[b] = SKIP
    return bytes(of)


CLASS_OF = _class_table()


def text_counts(text: bytes) -> tuple[int, int, int, int, int, list[int], list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, characters by class, and the words."""
    words = text.split()
    classes = text.translate(CLASS_OF)
    by_class = [classes.count(k) for k in range(SKIP + 1)]
    chars = len(text) - by_class[SKIP]
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    n = len(words)
    repeated = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(grams)) < len(grams):
            often = {g for g, k in Counter(grams).items() if k > 1}
            end = 0  # of the words counted so far
            for at, gram in enumerate(grams):
                if gram in often:
                    repeated += at + 3 - max(end, at)
                    end = at + 3
    return n, chars - by_class[BLANK], by_class[SYMBOL], len(lines) - len(set(lines)), repeated, by_class[:CLASSES], words


def js_distance(p: list[float], q: list[float]) -> float:
    """Square root of the Jensen-Shannon divergence in bits of two histograms; 1 if just one is empty."""
    a, b = sum(p), sum(q)
    if not a or not b:
        return 0.0 if a == b else 1.0
    total = 0.0
    for x, y in zip(p, q, strict=True):
        x, y = x / a, y / b
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
    return math.sqrt(max(0.0, total / 2))


def word_limit(common: list[int], n: int, share: float) -> float:
    """Word distance up to which texts are kept, for a reference of n words with these counts of common ones; 1,
    so that nothing is rejected, where the reference has none itself."""
    return share * js_distance([*[0] * len(common), 1], [*common, n - sum(common)]) if sum(common) else 1.0


def document_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Counts and histograms of each row; words has, for each language, its common words and then the rest."""
    lists = {k: [w.encode() for w in v] for k, v in COMMON_WORDS.items()}

    def make():
        def work(cols):
            out = {k: [] for k in (id_col, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "words")}
            for doc, lang, raw in zip(cols[id_col], cols[lang_col], cols[text_col], strict=True):
                n, chars, symbols, dup_lines, repeat, classes, words = text_counts(raw or b"")
                seen = Counter(words)
                out["words"].append([seen[w] for ws in lists.values() for w in ws])
                own = (doc, lang.decode() if lang in known else None, n, chars, symbols, dup_lines, repeat, classes)
                for k, v in zip(out, own, strict=False):
                    out[k].append(v)
            return out

        known = {k.encode() for k in COMMON_WORDS}
        return work

    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    return arrow_rows(
        docs.select(id_col, lang.alias(lang_col), text_col),
        make,
        f"`{id_col}` {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, words array<long>",
    )


def references(counts: DataFrame) -> dict[str, tuple[list[int], list[int], int]]:
    """For each known language the summed classes, words and word count of all texts that pass the base rules."""
    n_words = sum(map(len, COMMON_WORDS.values()))
    sums = [F.sum(F.element_at("classes", k + 1)).alias(f"c{k}") for k in range(CLASSES)] + [F.sum(F.element_at("words", k + 1)).alias(f"w{k}") for k in range(n_words)]
    rows = counts.filter("lang IS NOT NULL AND NOT base_failed").groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).collect()  # one row a known language
    return {r["lang"]: ([r[f"c{k}"] for k in range(CLASSES)], [r[f"w{k}"] for k in range(n_words)], r["n"]) for r in rows}


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_share: float = MAX_WORD_SHARE,
    min_words: int = MIN_WORDS_FOR_HISTOGRAM,
) -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance,
    base_failed and kept of every row.

    Words are runs of other characters than ASCII white space; null texts have none. n_repeat_words counts
    the words that lie in some window of three words found twice or more in the text. base_failed: fewer
    than 50 words, or more than half of them repeated. Distances are to the reference of the row's language;
    rows of a null or unknown language are compared to the nearest reference. They are null for texts of
    fewer than min_words words and where no reference exists; such texts aren't rejected by them. A word distance
    is too large above max_word_share of the one that a text without common words has to the same reference.
    Rows are judged one by one, so null or repeated ids don't matter.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = stored(document_counts(docs, id_col, text_col, lang_col).withColumn("base_failed", failed), "quality-counts")
    refs = references(counts)
    spans, at = {}, 0
    for lang, words in COMMON_WORDS.items():
        spans[lang] = slice(at, at + len(words))
        at += len(words)
    limits = {k: word_limit(common[spans[k]], n, max_word_share) for k, (_, common, n) in refs.items()}

    def make():
        def work(cols):
            class_distance, word_distance, near = [], [], []
            for lang, n, classes, words in zip(cols["lang"], cols["n_words"], cols["classes"], cols["words"], strict=True):
                best, limit = (None, None), None
                if n >= min_words and refs:
                    own = (lang or b"").decode()
                    pairs = []
                    for k in [own] if own in refs else refs:
                        ref_classes, ref_words, ref_n = refs[k]
                        common, ref_common = words[spans[k]], ref_words[spans[k]]
                        pairs.append(((js_distance(classes, ref_classes), js_distance([*common, n - sum(common)], [*ref_common, ref_n - sum(ref_common)])), limits[k]))
                    best, limit = min(pairs, key=lambda p: sum(p[0]))
                class_distance.append(best[0])
                word_distance.append(best[1])
                near.append(limit is None or (best[0] <= max_class_distance and best[1] <= limit))
            return {k: cols[k] for k in (id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")} | {"class_distance": class_distance, "word_distance": word_distance, "__near": near}

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    judged = arrow_rows(
        counts,
        make,
        f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, __near boolean",
    )
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("__near")).drop("__near")
