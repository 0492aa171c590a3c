"""Problem 5: noise of scanned pages, found and taken away.

One pass over the texts finds, per field of a record, the page furniture (lines
that are page numbers, lines that come again as running headers), the words
divided at line ends, and the field's distinct words with their counts. It is
written once; all else is counted on it, so the texts themselves are never
shuffled. In how many records each word stands gives the vocabulary.

A word may be a misreading only if a word in ``TIMES`` as many records exists, so
all but the words that no word exceeds so far are held against the vocabulary: a
trie of the frequent words is intersected with the word's Levenshtein automaton,
in which confusions of the scanner (one letter for another, or two letters for
one) cost 1 and any other edit costs ``EDIT``; all words within ``BUDGET`` are
found. The vocabulary is cut into bins by its words' beginnings and ends, each
with its own trie, and a word visits the bins that one of its originals can lie
in: an edit leaves the beginning or the end as it was, and confusions change a
beginning into few others.

An original reached by confusions alone makes its word surely misread. A word of
two or three letters, or an original reached by another edit inside a long word,
counts only in a field that has a surely misread word, and only beside a far more
frequent original (``FAR_TIMES``); edits at a word's ends are endings of the
language, not of the scanner. For the repair, the candidates are ranked by their
context: by the words of the record itself, then by cost, then by frequency.
Furniture is removed, divided words are joined and paragraphs reflowed.

Defined results: null, empty and blank texts have no noise and stay as they
are; a repeated load of a record counts once; a field's sections count together.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholaspark.llm.common import BROADCAST_LIMIT, table, written
from scholaspark.operators.documents import first_loads

BUDGET = 2
EDIT = 2
#: Words of one trie, and words held against it in one task.
BIN_WORDS = 50_000
SLICE_WORDS = 20_000
#: A misread word's original stands in so many records, and so many times more.
LEAST, TIMES, FAR_TIMES = 3, 10, 50
#: Letters of a word that is sure by itself, and of one with another edit inside.
SURE_LETTERS, LONG_LETTERS = 4, 7
#: From how many cases a field counts as noisy.
AT_LEAST = {"hyphenation": 2, "misread": 3, "header": 2, "page_number": 2}

#: What a scanner reads for what is printed.
CONFUSIONS = (
    ("l", "1"), ("i", "1"), ("I", "1"), ("o", "0"), ("O", "0"), ("s", "5"), ("S", "5"), ("b", "6"), ("g", "9"), ("B", "8"), ("z", "2"), ("i", "l"), ("l", "i"), ("l", "I"), ("I", "l"), ("c", "e"), ("e", "c"), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"),
    ("n", "u"), ("u", "n"), ("g", "q"), ("q", "g"), ("a", "á"), ("e", "é"), ("o", "ó"), ("i", "í"), ("u", "ú"), ("a", "à"), ("o", "ö"), ("u", "ü"), ("a", "ä"), ("i", "ï"),
    ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("w", "vv"), ("vv", "w"), ("h", "li"), ("li", "h"), ("m", "in"), ("in", "m"), ("m", "nn"), ("m", "ni"), ("ni", "m"), ("n", "ri"), ("ri", "n"), ("u", "ii"), ("n", "ii"), ("ll", "H"), ("k", "lc"), ("lc", "k"), ("b", "lo"), ("p", "lo"), ("h", "ln"), ("fi", "n"), ("tt", "H"),
)

#: By the first sign read: (printed, read).
_SWAPS: dict[str, list[tuple[str, str]]] = {}
for _printed, _read in dict.fromkeys((x.lower(), y.lower()) for x, y in CONFUSIONS):
    _SWAPS.setdefault(_read[0], []).append((_printed, _read))

_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_PAGE = re.compile(r"^\s*(?:\[?\(?(\d{1,4})\)?\]?|[pP](?:age|\.|g\.)? ?(\d{1,4})(?: ?(?:of|/) ?\d{1,4})?|[–—-]{1,2} ?(\d{1,4}|[ivxlc]{1,7}) ?[–—-]{1,2}|(?=[ivxlc])(x{0,3}(?:ix|iv|v?i{0,3}))|Seite (\d{1,4})|\d{1,4} ?/ ?\d{1,4})\s*$")
_BESIDE = re.compile(r"^(\S.*?\S)(?:\s{2,}|\s*\|\s*)(\d{1,4}|[ivxlc]{1,6})\s*$|^(\d{1,4}|[ivxlc]{1,6})(?:\s{2,}|\s*\|\s*)(\S.*?\S)\s*$")
_BREAK = re.compile(r"([^\W\d_]{2,})-$")
_FOLLOW = re.compile(r"\s*([^\W\d_]{2,})")
_MARKUP = set("<>{}|\\`=#*_$&/[]")


def _page_line(line: str) -> bool:
    m = _PAGE.match(line)
    return bool(m) and line.strip() != ""


def _key(line: str) -> str:
    """A line as it may come again: without case, signs and usual misreadings."""
    plain = line.lower()
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
    for a, b in (("rn", "m"), ("cl", "d"), ("vv", "w"), ("1", "l"), ("0", "o"), ("5", "s")):
        plain = plain.replace(a, b)
    return re.sub(r"[^\w]+", " ", plain).strip()


def _near(a: str, b: str) -> bool:
    """Whether two keys differ in a few letters of the same places at most."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 8:
        return False
    same = sum(x == y for x, y in zip(a, b)) + sum(x == y for x, y in zip(a[::-1], b[::-1]))
    return same >= max(len(a), len(b)) * 0.9 and (a[:4] == b[:4] or a[-4:] == b[-4:])


def _titled(line: str) -> bool:
    words = [w for w in re.findall(r"[^\W\d_]+", line) if len(w) > 3]
    return bool(words) and (sum(w[0].isupper() for w in words) >= 0.7 * len(words) or line.isupper())


class Layout:
    """What the lines of a text show of the pages they come from."""

    def __init__(self, text: str, title: str | None = None):
        self.lines = lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        n = len(lines)
        pages = [_page_line(x) for x in lines]
        # A column of figures isn't a page number.
        self.pages = [p and not (i and (pages[i - 1] or lines[i - 1].rstrip().endswith(":"))) and not (i + 1 < n and pages[i + 1]) for i, p in enumerate(pages)]
        first = next((i for i, x in enumerate(lines) if x.strip()), 0)
        keys: dict[int, str] = {}
        beside: set[int] = set()
        for i, line in enumerate(lines):
            bare = line.strip()
            if i == first or not 6 <= len(bare) <= 80 or pages[i]:
                continue
            m = _BESIDE.match(bare)
            if m:
                bare = m.group(1) or m.group(4)
            if not bare[0].isalpha() or bare[0].islower() or _MARKUP & set(bare) or bare.endswith((".", ":", ";", ",", "?", "!")) and not m:
                continue
            k = _key(bare)
            if k.count(" ") >= 1:
                keys[i] = k
                if m:
                    beside.add(i)
        groups: list[tuple[str, list[int]]] = []
        exact: dict[str, int] = {}
        ends: dict[tuple[str, str], list[int]] = {}
        for i, k in keys.items():
            at = exact.get(k)
            if at is None:
                # Lines that are near each other begin or end alike.
                marks = ("begin", k[:4]), ("end", k[-4:])
                near = sorted({j for x in marks for j in ends.get(x, ())})
                at = next((j for j in near if _near(k, groups[j][0])), None)
                if at is None:
                    at = len(groups)
                    groups.append((k, []))
                    for x in marks:
                        ends.setdefault(x, []).append(at)
                exact[k] = at
            groups[at][1].append(i)
        heads = [_key(x) for x in (lines[first] if lines else "", title or "") if x]
        self.headers = [False] * n
        for k, own in groups:
            if len(own) < 2:
                continue
            of_title = any(h.startswith(k) or k.startswith(h) or _near(h[: len(k)], k) for h in heads if len(h) >= 8)
            paged = any(i in beside or (i and self.pages[i - 1]) or (i + 1 < n and self.pages[i + 1]) for i in own)
            if of_title or paged or sum(_titled(lines[i]) for i in own) * 2 > len(own):
                for i in own:
                    self.headers[i] = True
        self.beside = [self.headers[i] and i in beside for i in range(n)]
        self.furniture = [a or b for a, b in zip(self.pages, self.headers)]
        # Lines of the text itself, and where one is followed by a broken line.
        self.body = [i for i in range(n) if not self.furniture[i]]
        self.breaks: list[tuple[int, int, str, str]] = []
        full = [i for i in self.body if lines[i].strip()]
        wrapped = 0
        for a, b in zip(full, full[1:]):
            gap = any(not lines[j].strip() for j in range(a + 1, b))
            if not gap:
                wrapped += len(lines[a].strip()) >= 25
            above = lines[a].rstrip()
            if gap or not above.endswith("-"):
                continue
            m, follow = _BREAK.search(above), _FOLLOW.match(lines[b])
            if m and follow:
                self.breaks.append((a, b, m.group(1), follow.group(1)))
        self.wrapped = wrapped >= 3

    def counts(self) -> dict[str, int]:
        return {"header": sum(self.headers), "page_number": sum(self.pages) + sum(self.beside)}

    def text(self) -> str:
        """The text without furniture, its divided words joined, in paragraphs."""
        joins = {a: b for a, b, _, _ in self.breaks}
        paragraphs: list[str] = []
        open_ = ""
        last = None
        for i in self.body:
            line = self.lines[i].strip()
            if not line:
                if open_ and not (last is not None and last in joins):
                    paragraphs.append(open_)
                    open_ = ""
                continue
            if last is not None and joins.get(last) == i and open_.endswith("-"):
                open_ = open_[:-1] + line
            elif open_ and self._goes_on(last, i):
                open_ += " " + line
            else:
                if open_:
                    paragraphs.append(open_)
                open_ = line
            last = i
        if open_:
            paragraphs.append(open_)
        return "\n\n".join(paragraphs)

    def _goes_on(self, a: int | None, b: int) -> bool:
        """Whether line b goes on with line a's paragraph."""
        if a is None or not self.wrapped:
            return False
        above, below = self.lines[a].strip(), self.lines[b].strip()
        heading = len(above) < 40 and not above.endswith((".", ",", ";", "-")) and (bool(re.match(r"\d+(\.\d+)* \S|Abstract$", above)))
        return not heading and not re.match(r"(?:[-•*–▪]|\d+[.)]) ", below)


def words_of(layout: Layout) -> Counter:
    """The words of the text, divided ones joined, in lower case."""
    parts = []
    joins = {a: b for a, b, _, _ in layout.breaks}
    for i in layout.body:
        line = layout.lines[i].rstrip()
        if i in joins:
            parts.append(line[:-1])
        else:
            parts.append(line + "\n")
    found = Counter(_WORD.findall("".join(parts).lower()))
    return Counter({w: n for w, n in found.items() if len(w) >= 2})


class Trie:
    """The vocabulary, and its intersection with a word's automaton."""

    def __init__(self, words: list[tuple[str, int]]):
        self.root: dict = {}
        for w, n in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = n

    def candidates(self, word: str, budget: int = BUDGET, edit: int = EDIT) -> dict[str, tuple[int, bool, int]]:
        """{original: (cost, by confusions only, records)} within the budget."""
        found: dict[str, tuple[int, bool, int]] = {}
        seen: dict[tuple[int, int, bool], int] = {}
        size = len(word)
        stack = [(self.root, 0, 0, True, "")]
        while stack:
            node, at, cost, pure, made = stack.pop()
            mark = id(node), at, pure
            if seen.get(mark, budget + 1) <= cost:
                continue
            seen[mark] = cost
            if at == size:
                n = node.get("")
                if n is not None and cost:
                    old = found.get(made)
                    if old is None or (cost, not pure) < (old[0], not old[1]):
                        found[made] = (cost, pure, n)
            else:
                c = word[at]
                child = node.get(c)
                if child is not None:
                    stack.append((child, at + 1, cost, pure, made + c))
            if cost < budget and at < size:
                for printed, read in _SWAPS.get(word[at], ()):
                    if word.startswith(read, at):
                        child = node
                        for p in printed:
                            child = child.get(p)
                            if child is None:
                                break
                        if child is not None:
                            stack.append((child, at + len(read), cost + 1, pure, made + printed))
            if cost + edit <= budget:
                if at < size:
                    stack.append((node, at + 1, cost + edit, False, made))
                for c, child in node.items():
                    if c:
                        stack.append((child, at, cost + edit, False, made + c))
                        if at < size and c != word[at]:
                            stack.append((child, at + 1, cost + edit, False, made + c))
        return found


def fields_of(full_text: str | None, sections: list | None) -> list[tuple[str, str]]:
    texts = [s["text"] for s in sections or () if s and s["text"] and not s["text"].isspace()]
    found = [("full_text", full_text)] if full_text and not full_text.isspace() else []
    return found + ([("sections", "\n\n".join(texts))] if texts else [])


_FIELD = "struct<field string, noise array<string>, divided array<struct<word string, other string, n int>>, words array<string>, counts array<int>>"
_KINDS = pa.list_(
    pa.struct(
        [
            ("field", pa.string()),
            ("noise", pa.list_(pa.string())),
            ("divided", pa.list_(pa.struct([("word", pa.string()), ("other", pa.string()), ("n", pa.int32())]))),
            ("words", pa.list_(pa.string())),
            ("counts", pa.list_(pa.int32())),
        ]
    )
)


def passed(papers: DataFrame) -> DataFrame:
    """(load, record_key, fields): the one pass. A row for each load of a
    record; of each field with text its noise of the layout, the divided words
    (also as they would be written with a hyphen) and all words with counts."""
    source = papers.select(F.col("doc_id").cast("string").alias("k"), F.col("title").alias("t"), "full_text", "sections")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = []
                for t, full, sections in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    fields = []
                    for field, text in fields_of(full, sections):
                        layout = Layout(text, t)
                        divided = Counter(((a + b).lower(), f"{a}-{b}".lower()) for _, _, a, b in layout.breaks)
                        words = words_of(layout)
                        noise = [what for what, n in layout.counts().items() if n >= AT_LEAST[what]]
                        fields.append({"field": field, "noise": noise, "divided": [{"word": w, "other": o, "n": n} for (w, o), n in divided.items()], "words": list(words), "counts": list(words.values())})
                    rows.append(fields)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _KINDS)], ["record_key", "fields"])

    return source.mapInArrow(run, f"record_key string, fields array<{_FIELD}>").select(F.monotonically_increasing_id().alias("load"), "record_key", "fields")


def vocabulary_of(rows: DataFrame) -> DataFrame:
    """(word, records) of all words of the passed rows."""
    each = rows.select(F.explode(F.array_distinct(F.flatten(F.transform("fields", lambda f: f["words"])))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("records"))


def beginnings(word: str, letters: int = 2, budget: int = BUDGET) -> set[str]:
    """The beginnings of the words that confusions can have made this word of."""
    found, seen, stack = set(), set(), [("", 0, 0)]
    while stack:
        made, at, cost = stack.pop()
        if len(made) >= letters or at == len(word):
            found.add(made[:letters])
            continue
        if (made, at, cost) in seen:
            continue
        seen.add((made, at, cost))
        stack.append((made + word[at], at + 1, cost))
        if cost < budget:
            stack += [(made + printed, at + len(read), cost + 1) for printed, read in _SWAPS.get(word[at], ()) if word.startswith(read, at)]
    return found


def bins_of(word: str, asked: bool, number: int) -> list[int]:
    """The bins of a word of the vocabulary, and those an asked one visits."""
    routes = {f"<{x}" for x in (beginnings(word) if asked else {word[:2]})} | {f">{word[-2:]}", f"<{word[:2]}"}
    return sorted({zlib.crc32(x.encode()) % number for x in routes})


def candidates(rare: DataFrame, vocabulary: DataFrame, bin_words: int = BIN_WORDS, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(word, original, cost, pure, records): the frequent words within the
    budget of each asked word."""
    frequent = written(vocabulary.where(F.col("records") >= LEAST))
    number = max(1, -(-2 * frequent.count() // bin_words))
    rare = written(rare.select("word").distinct())
    slices = max(1, -(-rare.count() // (number * slice_words)))

    def routed(asked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [bins_of(w, asked, number) for w in batch.column(0).to_pylist()]
                at = pa.array([i for i, x in enumerate(own) for _ in x], pa.int32())
                part = batch.take(at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for xs in own for x in xs], pa.int32())], [*batch.schema.names, "bin"])

        return run

    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    v = frequent.select("word", "records").mapInArrow(routed(False), "word string, records long, bin int").withColumn("slice", every)
    u = rare.mapInArrow(routed(True), "word string, bin int").withColumn("slice", F.pmod(F.xxhash64("word"), F.lit(slices)).cast("int"))

    def intersect(words: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(list(zip(words["word"], words["records"])))
        rows = [(w, o, c, p, n) for w in asked["word"] for o, (c, p, n) in trie.candidates(w).items()]
        return pd.DataFrame(rows, columns=["word", "original", "cost", "pure", "records"])

    both = v.groupBy("bin", "slice").cogroup(u.groupBy("bin", "slice"))
    found = both.applyInPandas(intersect, "word string, original string, cost int, pure boolean, records long")
    # A word may meet an original in several bins.
    return found.distinct()


def misreadings(vocabulary: DataFrame) -> DataFrame:
    """(word, original, cost, records, sure): what each misread word may be."""
    most = vocabulary.agg(F.max("records")).first()[0] or 0
    asked = vocabulary.where((F.col("records") * TIMES <= F.lit(most)) & F.col("word").rlike(r"\p{L}"))
    found = candidates(asked, vocabulary).join(asked.select("word", F.col("records").alias("own")), "word")
    n, sure_size = F.length("word"), (F.length("word") >= SURE_LETTERS) | F.col("word").rlike(r"\d")
    long = (n >= LONG_LETTERS) & (F.length("original") >= LONG_LETTERS)
    inside = (F.left("word", F.lit(2)) == F.left("original", F.lit(2))) & (F.right("word", F.lit(2)) == F.right("original", F.lit(2)))
    far = F.col("records") >= F.col("own") * FAR_TIMES
    sure = F.col("pure") & sure_size
    likely = far & ((F.col("pure") & ~sure_size) | (~F.col("pure") & long & inside))
    kept = found.where((F.col("records") >= F.col("own") * TIMES) & (sure | likely))
    return kept.select("word", "original", "cost", "records", sure.alias("sure"))


def _small(df: DataFrame, bytes_a_row: int = 64) -> bool:
    return df.count() * bytes_a_row <= BROADCAST_LIMIT


def _field_words(rows: DataFrame) -> DataFrame:
    fields = rows.select("load", "record_key", F.explode("fields").alias("f")).select("load", "record_key", "f.field", F.explode(F.arrays_zip("f.words", "f.counts")).alias("w"))
    return fields.select("load", "record_key", "field", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))


def _misread(rows: DataFrame, fixes: DataFrame) -> DataFrame:
    """(load, record_key, field, n): the number of misread words, which is that
    of the surely misread ones and, if there are any, of the likely ones."""
    known = fixes.groupBy("word").agg(F.max("sure").alias("sure"))
    known = F.broadcast(known) if _small(fixes) else known
    sums = _field_words(rows).join(known, "word").groupBy("load", "record_key", "field").agg(F.sum("n").alias("n"), F.max("sure").alias("any"))
    return sums.where("any").drop("any")


def noise(papers: DataFrame) -> DataFrame:
    """(record_key, field, noise)."""
    rows = written(passed(papers))
    vocabulary = written(vocabulary_of(rows))
    fields = rows.select("load", "record_key", F.explode("fields").alias("f"))
    layout = fields.select("record_key", "f.field", F.explode("f.noise").alias("noise"))
    divided = fields.select("load", "record_key", "f.field", F.explode("f.divided").alias("d")).select("load", "record_key", "field", "d.*")
    joined = vocabulary.select("word", F.col("records").alias("whole"))
    hyphened = vocabulary.select(F.col("word").alias("other"), F.col("records").alias("compound"))
    # A compound that is written with a hyphen elsewhere isn't divided.
    kept = divided.join(joined, "word", "left").join(hyphened, "other", "left").where("compound is null or whole >= compound")
    cut = kept.groupBy("load", "record_key", "field").agg(F.sum("n").alias("n"))
    misread = _misread(rows, written(misreadings(vocabulary)))
    wide = lambda df, what: df.where(F.col("n") >= AT_LEAST[what]).select("record_key", "field", F.lit(what).alias("noise"))
    return layout.unionByName(wide(cut, "hyphenation")).unionByName(wide(misread, "misread")).distinct()


def repair(text: str, fixes: dict[str, list[tuple[str, int, int, bool]]], title: str | None = None) -> str:
    """The text without furniture, reflowed, its misread words replaced.

    ``fixes`` has (original, cost, records, sure) by misread word; of several the
    one the record itself uses most comes first, then the cheapest, then the most
    frequent, then the first in order. Without any sure one nothing is replaced.
    """
    layout = Layout(text, title)
    own = {w: fixes[w] for w in words_of(layout) if w in fixes}
    if not any(o[3] for x in own.values() for o in x):
        own = {}
    if not (any(layout.furniture) or layout.breaks or layout.wrapped or own):
        return text
    plain = layout.text()
    if not own:
        return plain
    context = Counter(_WORD.findall(plain.lower()))

    def fix(m: re.Match) -> str:
        word = m.group()
        options = own.get(word.lower())
        if not options:
            return word
        best = min(options, key=lambda o: (-context[o[0]], o[1], -o[2], o[0]))[0]
        return best.upper() if word.isupper() and len(word) > 1 else best[0].upper() + best[1:] if word[0].isupper() else best

    return _WORD.sub(fix, plain)


def repaired(papers: DataFrame) -> DataFrame:
    """(doc_id, full_text, sections): the texts as continuous paragraphs. The
    misreadings go to every task if they are few; else each record gets its own."""
    rows = written(passed(papers))
    fixes = written(misreadings(written(vocabulary_of(rows))))
    source = first_loads(papers.select("doc_id", "title", "full_text", "sections"), ["doc_id"], [F.xxhash64("title", "full_text")])
    section = pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())]))
    few = _small(fixes)
    by: dict[str, list] = {}
    for r in fixes.collect() if few else ():
        by.setdefault(r.word, []).append((r.original, r.cost, r.records, r.sure))
    sent = papers.sparkSession.sparkContext.broadcast(by)
    none = F.array().cast("array<struct<word string, original string, cost int, records long, sure boolean>>")
    if few:
        source = source.withColumn("fixes", none)
    else:
        own = _field_words(rows).select("record_key", "word").distinct().join(fixes, "word").groupBy(F.col("record_key").alias("doc_id")).agg(F.collect_list(F.struct("word", "original", "cost", "records", "sure")).alias("fixes"))
        source = source.join(own, "doc_id", "left").withColumn("fixes", F.coalesce("fixes", none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            full, parts = [], []
            for t, text, sections, own in zip(c["title"], c["full_text"], c["sections"], c["fixes"]):
                fix = sent.value
                if own:
                    fix = {}
                    for f in own:
                        fix.setdefault(f["word"], []).append((f["original"], f["cost"], f["records"], f["sure"]))
                full.append(text if not text else repair(text, fix, t))
                parts.append(None if sections is None else [None if s is None else {"heading": s["heading"], "text": s["text"] and repair(s["text"], fix, t)} for s in sections])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(full, pa.string()), pa.array(parts, section)], ["doc_id", "full_text", "sections"])

    return source.mapInArrow(run, "doc_id string, full_text string, sections array<struct<heading string, text string>>")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise(table(spark, sf_dir, "papers")).withColumnRenamed("record_key", "doc_id")


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired texts of every paper."""
    return repaired(table(spark, sf_dir, "papers"))


QUERIES = {"p5_found": p5_found, "p5_repaired": p5_repaired}
SQL: dict[str, str] = {}
