"""Problem 3: figures of a text, and whether it is prose, a list, a table or junk.

Beside basic counts, a text is described by four distributions: of its
characters over classes, of its words over kinds (function words by language,
other words by form), of its lines over kinds of beginning and end, and of its
lines over lengths. Profiles are such distributions of labelled texts; texts
of one kind that lie close together share a profile. A text gets the kind of
the profile nearest to it by the weighted Jensen-Shannon divergence.

The profiles come from the labelled sample (at most ``LABELLED`` rows of it,
taken by hash of the key; the bound is a parameter of the model only) and from
a few written examples of each kind, which alone serve where no sample exists.
The profiles are a few hundred rows of about 60 numbers, and go to every task.

Defined results: for null, empty and blank texts all counts are 0 and the kind
is null; a repeated load of a chunk counts once.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholaspark.llm.common import bounded_rows, table

#: Most labelled rows that the profiles are made from.
LABELLED = 4000
#: Texts closer than this to a profile of their kind join it.
JOIN = 0.05
#: A text this far from every profile may be a mixture and is taken apart into
#: segments of about SEGMENT characters, which vote with their sizes.
APART = 0.1
SEGMENT = 400
#: Weights of the four distributions.
WEIGHTS = (0.35, 0.3, 0.2, 0.15)
KINDS = ("prose", "list", "table", "junk")

#: Character classes.
(LOWER, UPPER, DIGIT, SPACE, NEWLINE, TAB, STOP, COMMA, PIPE, BRACKET, QUOTE, DASH, CURRENCY, LETTERLIKE, CJK, MARK, BROKEN, SYMBOL) = range(18)
_CLASSES = 18
_FIXED = {" ": SPACE, "\n": NEWLINE, "\r": NEWLINE, "\t": TAB, ".": STOP, "!": STOP, "?": STOP, "。": STOP, "！": STOP, "？": STOP, ",": COMMA, ";": COMMA, ":": COMMA, "，": COMMA, "|": PIPE, "'": QUOTE, '"': QUOTE, "’": QUOTE, "“": QUOTE, "”": QUOTE, "-": DASH, "–": DASH, "—": DASH, "�": BROKEN, "□": BROKEN}
#: Word kinds after the languages' function words.
(PLAIN, CAPITAL, SINGLE, NUMBER, MIXED, LONG, SIGN) = range(7)
_LANGS = ("de", "en", "es", "fr", "zh")
_WORDS = len(_LANGS) + 7
#: Line kinds: by beginning and by end.
_LINE_KINDS = 10
_LINE_SIZES = (0, 12, 24, 40, 60, 80, 120, 240)

#: Written examples of each kind.
EXAMPLES = {
    "prose": (
        "The river rose in the night, and by the morning the lower road was under water. Nobody had expected it to last, but it did.",
        "Wir haben lange darüber gesprochen, ob die Reise im Winter überhaupt möglich ist. Am Ende sind wir mit dem Zug gefahren.",
        "Nous avons longtemps parlé de cette maison avant de la vendre. Elle est au bord de la mer, et le jardin ne manque pas de fleurs.",
        "El viaje fue más largo de lo que pensaba, pero no me arrepiento de nada. Cuando llegamos, la casa estaba abierta.",
        "我们在河边走了很久，但是没有看见他。因此我们回家了，天已经黑了。",
        "It is easy to see why the\nmeasure failed in the end, as\nno one could say what it\nwas for or who should pay.",
    ),
    "list": (
        "- apples and pears\n- a loaf of bread\n- butter\n- two lemons\n- salt\n- a bag of rice",
        "1. wash the beans\n2. boil water\n3. add salt\n4. wait ten minutes\n5. drain\n6. serve",
        "1 Introduction .............. 3\n2 The first years ........... 9\n3 The war ................... 17\n4 After the war ............. 40",
        "[1] Smith A. On the growth of towns. City Studies, 1987.\n[2] Jones B. Roads and rivers. Map Letters, 1990.\n[3] Brown C. The old port. City Studies, 1992.",
        "small tools\nheavy gloves\nred paint\nwooden frames\ncopper wire\nspare keys",
    ),
    "table": (
        "| name | size | cost |\n|---|---|---|\n| nail | 3 | 0.2 |\n| bolt | 7 | 1.4 |\n| hinge | 9 | 3.5 |",
        "Year\tRain\tSun\n1990\t12.5\t33\n1991\t14.1\t35\n1992\t11.0\t39",
        "town,north,south\n12.4,3.3,5.1\n4.4,6.2,7.0\n9.1,2.2,8.6",
        "Alpha      12.4     3.3     5.1\nBeta        4.4     6.2     7.0\nGamma       9.1     2.2     8.6",
        "oak; 12; yes; 3.4\nelm; 9; no; 2.2\nash; 14; n/a; 7.5\nfir; 3; yes; 1.8",
    ),
    "junk": (
        "%&/( ##+ ?=)( *~ ;:_ <>| ^^ ,.- !! $$ }{ ][ @@ ~~ ++ %% //",
        "����□□ Ã¤Ã¼â€™ ©®™ ��□ Ã¶ÃŸ â€œ ���",
        "dGhpcyBpcyBub3QgYSB0ZXh0QmFzZTY0RW5jb2RlZERhdGFTdHJlYW1XaXRob3V0U3BhY2VzQXRBbGw5OTE2",
        "54 6869 7320 6973 206e 6f74 2061 2074 6578 7420 6275 7420 6865 7820 6279 7465 73",
        "T h e r e a r e s p a c e s b e t w e e n a l l t h e l e t t e r s h e r e",
        "(cid:12) (cid:44) (cid:7) (cid:190) (cid:33) (cid:81) (cid:5)",
        "Home Login Search Next Home Login Search Next Home Login Search Next",
    ),
}


@lru_cache(maxsize=1)
def _class_of() -> np.ndarray:
    def one(c: int) -> int:
        ch = chr(c)
        if ch in _FIXED:
            return _FIXED[ch]
        kind = unicodedata.category(ch)
        if kind[0] == "L":
            if 0x2E80 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7AF or 0x20000 <= c <= 0x3FFFF:
                return CJK
            return {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER}.get(kind, LETTERLIKE)
        by = {"Nd": DIGIT, "Zs": SPACE, "Ps": BRACKET, "Pe": BRACKET, "Pd": DASH, "Sc": CURRENCY, "Cn": BROKEN, "Co": BROKEN, "Cs": BROKEN, "Cc": BROKEN}
        return by.get(kind, MARK if kind[0] == "M" else SYMBOL)

    found = np.full(0x110000, BROKEN, np.uint8)
    found[:0x30000] = np.fromiter(map(one, range(0x30000)), np.uint8, 0x30000)
    return found


def _line_kind(line: str) -> tuple[int, int]:
    """(kind of beginning, kind of end) of a stripped line."""
    first, last = line[0], line[-1]
    if first.isdigit():
        begin = 0
    elif first.isalpha():
        begin = 1
    elif first in "([" and len(line) > 2 and (line[2] in ")]" or line[1].isdigit()):
        begin = 2
    elif len(line) > 1 and line[1] == " ":
        begin = 3
    else:
        begin = 4
    if last in ".!?。！？":
        end = 0
    elif last.isdigit():
        end = 1
    elif last.isalpha():
        end = 2
    elif last in ",;:":
        end = 3
    else:
        end = 4
    return begin, end


def _word_kind(word: str) -> int:
    if word.isalpha():
        if len(word) == 1 and word.isascii():
            return SINGLE
        if len(word) > 40:
            return LONG
        return CAPITAL if word[0].isupper() else PLAIN
    core = word.strip(".,;:()[]±%-")
    if core.replace(".", "").replace(",", "").isdigit():
        return NUMBER
    if not any(map(str.isalnum, word)):
        return SIGN
    if len(word) > 40:
        return LONG
    if core.replace("-", "").replace("'", "").isalpha():
        return CAPITAL if core[0].isupper() else PLAIN
    return MIXED


#: Kinds of the words met so far; of bounded size, and the same for any order.
_WORD_MEMO: dict[str, tuple[int, ...]] = {}

FIGURES = ("n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "distinct_words", "repeated_lines")


def describe(text: str, common: dict[str, int]) -> tuple[list[float], list[np.ndarray]]:
    """The figures of a text and its distributions (as counts)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.bincount(_class_of()[codes], minlength=_CLASSES).astype(float)
    words = text.split()
    kinds = np.zeros(_WORDS)
    lang = np.zeros(len(_LANGS))
    known = 0
    seen_words = Counter(words)
    for word, n in seen_words.items():
        at = _WORD_MEMO.get(word)
        if at is None:
            hit = common.get(word) or common.get(word.strip(".,;:!?()«»“”\"'").lower())
            at = hit if hit is not None else (-1, _word_kind(word))
            if len(_WORD_MEMO) < 200_000:
                _WORD_MEMO[word] = at
        if at[0] >= 0:
            known += n
            for k in at:
                lang[k] += n / len(at)
        else:
            kinds[len(_LANGS) + at[1]] += n
    if chars[CJK]:
        # Chinese isn't divided by blanks: its common words are looked up inside.
        hits = sum(text.count(w) for w, at in common.items() if at == (_LANGS.index("zh"),))
        lang[_LANGS.index("zh")] += min(hits, chars[CJK] / 4)
        kinds[len(_LANGS) + PLAIN] += chars[CJK] / 4
    # One language is the text's; words of others are ordinary words.
    best = int(lang.argmax())
    kinds[best] += lang[best]
    kinds[len(_LANGS) + PLAIN] += lang.sum() - lang[best]
    kinds = np.concatenate([[kinds[: len(_LANGS)].sum()], kinds[len(_LANGS) :]])
    # A line is what a reader would see as one; wrapped lines of a paragraph
    # have like sizes and no mark at their ends.
    lines = [x for x in map(str.strip, text.splitlines()) if x]
    forms, sizes = np.zeros(_LINE_KINDS), np.zeros(len(_LINE_SIZES))
    for line in lines:
        b, e = _line_kind(line)
        forms[b] += 1
        forms[5 + e] += 1
        sizes[np.searchsorted(_LINE_SIZES, len(line), "right") - 1] += 1
    letters = chars[[LOWER, UPPER, LETTERLIKE, CJK, MARK]].sum()
    seen = chars.sum() - chars[[SPACE, NEWLINE, TAB]].sum()
    n = max(len(words), 1)
    figures = [
        float(len(text)), float(len(words)), float(len(lines)), sum(map(len, words)) / n, (seen - letters - chars[DIGIT]) / max(seen, 1.0), chars[DIGIT] / max(seen, 1.0),
        forms[5] / max(len(lines), 1), known / n, len(seen_words) / n, 1 - len(set(lines)) / max(len(lines), 1),
    ]
    repeated = np.array([len(seen_words) / n, 1 - len(seen_words) / n])
    return figures, [chars, np.concatenate([kinds, repeated * n * 0.5]), forms, sizes * 1.0]


def normalised(counts: list[np.ndarray]) -> np.ndarray:
    """The weighted distributions side by side."""
    return np.concatenate([w * c / max(c.sum(), 1e-9) for w, c in zip(WEIGHTS, counts)])


def divergence(p: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Weighted Jensen-Shannon divergence in bits of each row of p from every
    profile: the entropy of the mean less the mean of the entropies."""

    def entropy(x: np.ndarray) -> np.ndarray:
        return -(x * np.log2(np.maximum(x, np.float32(1e-20)))).sum(axis=-1)

    p, profiles = np.atleast_2d(p).astype(np.float32), profiles.astype(np.float32)
    own, other = entropy(p), entropy(profiles)
    columns = [entropy((p + q) / 2) - (own + o) / 2 for q, o in zip(profiles, other)]
    return np.stack(columns, axis=1)


class Profiles:
    """The profiles of the kinds."""

    def __init__(self, labelled: list[tuple[str, str]], common: dict[str, tuple[int, ...]], join: float = JOIN, described: list[tuple[str, np.ndarray]] | None = None):
        self.common = common
        rows = [(k, normalised(describe(t, common)[1])) for k, t in labelled if k in KINDS and t and not t.isspace()] + (described or [])
        rows += [(k, normalised(describe(t, common)[1])) for k, ts in EXAMPLES.items() for t in ts]
        sums: list[np.ndarray] = []
        sizes: list[int] = []
        kinds: list[str] = []
        for kind, p in rows:
            own = [i for i, k in enumerate(kinds) if k == kind]
            if own:
                d = divergence(p, np.array([sums[i] / sizes[i] for i in own]))[0]
                at = int(d.argmin())
                if d[at] < join:
                    sums[own[at]] = sums[own[at]] + p
                    sizes[own[at]] += 1
                    continue
            sums.append(p)
            sizes.append(1)
            kinds.append(kind)
        self.kinds = kinds
        self.matrix = np.array([s / n for s, n in zip(sums, sizes)])

    def nearest(self, ps: np.ndarray) -> list[tuple[str, float]]:
        """(kind, divergence) of the profile nearest to each row."""
        d = divergence(ps, self.matrix)
        at = d.argmin(axis=1)
        return [(self.kinds[a], float(max(d[i, a], 0.0))) for i, a in enumerate(at)]


def segments(text: str) -> list[str]:
    """Runs of lines of about SEGMENT characters; a paragraph's end closes one early."""
    found: list[list[str]] = [[]]
    held = 0
    for line in text.splitlines():
        blank = not line.strip()
        if held >= SEGMENT or (blank and held >= SEGMENT // 2):
            found.append([])
            held = 0
        if not blank:
            found[-1].append(line)
            held += len(line)
    return ["\n".join(x) for x in found if x]


def classify(texts: list[str], model: Profiles) -> list[tuple[list[float], str, float]]:
    """(figures, kind, divergence) of each text; none may be blank."""
    described = [describe(t, model.common) for t in texts]
    near = model.nearest(np.array([normalised(counts) for _, counts in described]))
    found = []
    for text, (figures, _), (kind, d) in zip(texts, described, near):
        parts = segments(text) if d > APART and len(text) > SEGMENT else []
        if len(parts) > 1:
            votes = dict.fromkeys(KINDS, 0)
            for part, (k, _) in zip(parts, model.nearest(np.array([normalised(describe(p, model.common)[1]) for p in parts]))):
                votes[k] += len(part)
            kind = max(KINDS, key=votes.get)
        found.append((figures, kind, d))
    return found


def common_words(rows: list) -> dict[str, tuple[int, ...]]:
    found: dict[str, tuple[int, ...]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.word)):
        if r.lang in _LANGS:
            found[r.word] = (*found.get(r.word, ()), _LANGS.index(r.lang))
    return found


def profiles_of(chunks: DataFrame, labels: DataFrame, words: DataFrame, labelled: int = LABELLED) -> Profiles:
    """Profiles from a bounded sample of the labelled chunks. Its texts are
    described where they are; only their distributions come to the driver."""
    common = common_words(bounded_rows(words.select("lang", "word").where("lang is not null and word is not null"), "the table of common words"))
    sample = labels.select("chunk_id", "kind").where(F.col("kind").isin(*KINDS)).distinct().orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(labelled)
    texts = chunks.select("chunk_id", "text").where("text is not null").join(F.broadcast(sample), "chunk_id")
    sent = chunks.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            full = [i for i, t in enumerate(c["text"]) if not t.isspace() and t]
            rows = [normalised(describe(c["text"][i], sent.value)[1]).tolist() for i in full]
            yield pa.RecordBatch.from_arrays([pa.array([c[n][i] for i in full], pa.string()) for n in ("chunk_id", "kind")] + [pa.array(rows, pa.list_(pa.float64()))], ["chunk_id", "kind", "p"])

    rows = texts.mapInArrow(run, "chunk_id string, kind string, p array<double>").dropDuplicates(["chunk_id", "kind"]).collect()
    return Profiles([], common, described=[(k, np.array(p)) for _, k, p in sorted((r.chunk_id, r.kind, r.p) for r in rows)])


def statistics(df: DataFrame, key: str, text: str, profiles: Profiles) -> DataFrame:
    """(key, figures..., kind, divergence) of every text."""
    source = df.select(df[key].alias("item_key"), df[text].alias("item_text"))
    key_kind = source.schema["item_key"].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(profiles)
    names = ["item_key", *FIGURES, "kind", "divergence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = part.column(1).to_pylist()
                rows = [[*[0.0] * len(FIGURES), None, None] for _ in texts]
                full = [i for i, t in enumerate(texts) if t and not t.isspace()]
                if full:
                    for i, (figures, kind, d) in zip(full, classify([texts[i] for i in full], model)):
                        rows[i] = [*figures, kind, d]
                columns = [pa.array([r[i] for r in rows], pa.string() if names[i + 1] == "kind" else pa.float64()) for i in range(len(names) - 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    schema = ", ".join(f"{n} {'string' if n == 'kind' else key_kind if n == 'item_key' else 'double'}" for n in names)
    return source.mapInArrow(run, schema).withColumnRenamed("item_key", key)


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks")
    model = profiles_of(chunks, table(spark, sf_dir, "chunk_kinds"), table(spark, sf_dir, "common_words"))
    return statistics(chunks, "chunk_id", "text", model)


def p3_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of every chunk."""
    return _statistics(spark, sf_dir).dropDuplicates(["chunk_id"])


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those figures of every chunk that SQL can say too."""
    whole = lambda c: F.col(c).cast("long").alias(c)
    return p3_stats(spark, sf_dir).select("chunk_id", whole("n_chars"), whole("n_words"), whole("n_lines"), F.round("mean_word_length", 6).alias("mean_word_length"), F.round("distinct_words", 6).alias("distinct_words"), F.round("repeated_lines", 6).alias("repeated_lines"), F.round("punctuated_lines", 6).alias("punctuated_lines"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that are a list, a table or junk."""
    return _statistics(spark, sf_dir).where("kind <> 'prose'").select("chunk_id", "kind").distinct()


QUERIES = {"p3_stats": p3_stats, "p3_counts": p3_counts, "p3_found": p3_found}
_BLANK = r"[\s\x0b\pZ\x1c-\x1f\x85]"
SQL = {
    "p3_counts": rf"""
WITH c AS (SELECT chunk_id, coalesce(any_value(text), '') AS t FROM chunks GROUP BY chunk_id),
d AS (
  SELECT chunk_id, t, list_filter(regexp_split_to_array(t, '{_BLANK}+'), lambda x: x <> '') AS w,
         list_filter(list_transform(regexp_split_to_array(t, '[\n\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: x <> '') AS l
  FROM c
)
SELECT chunk_id, CASE WHEN len(w) = 0 THEN 0 ELSE length(t) END AS n_chars, CAST(len(w) AS BIGINT) AS n_words, CAST(len(l) AS BIGINT) AS n_lines,
       round(CASE WHEN len(w) = 0 THEN 0.0 ELSE CAST(list_sum(list_transform(w, lambda x: length(x))) AS DOUBLE) / len(w) END, 6) AS mean_word_length,
       round(CASE WHEN len(w) = 0 THEN 0.0 ELSE CAST(len(list_distinct(w)) AS DOUBLE) / len(w) END, 6) AS distinct_words,
       round(CASE WHEN len(w) = 0 THEN 0.0 ELSE 1 - CAST(len(list_distinct(l)) AS DOUBLE) / len(l) END, 6) AS repeated_lines,
       round(CASE WHEN len(w) = 0 THEN 0.0 ELSE CAST(len(list_filter(l, lambda x: contains('.!?。！？', right(x, 1)))) AS DOUBLE) / len(l) END, 6) AS punctuated_lines
FROM d
"""
}
