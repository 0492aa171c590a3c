"""Problem 6: the spellings of one person or organisation, linked.

Distinct spellings are read into parts (family name, given name, initials; or
place and kind of body). Every pair that ``link`` accepts meets in a block: by
the whole family name, by a given name (or one it is short for, or one learned),
or by a word of the kind of body. A block of more than ``COMMON`` spellings is
taken apart without losing such a pair: one of a family name by the letters and
endings that linked given names share, any other by the family names in it that
are alike, found by what is left of them without a few letters (long ones by
their segments). What stays large is compared in slices. Candidates are compared
by the ratio of their longest common subsequence and by their edits, part by
part.

Given names that are different words (a short form that is in no list) count as
one if they share family names far more often than chance would have it; that
is counted over all spellings with the Gram matrix of problem 4.

A spelling with only an initial is weak: it joins the one person of that family
name whose given name it fits, and none if it fits several. The spellings are
then linked over chains of links.

Defined results: null and empty names are no spellings; other blank or unlettered
names are linked with nothing; a spelling counts once however often it occurs;
persons and organisations are never linked.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholaspark.llm.common import bounded_rows, components, table, written
from scholaspark.llm.p04_pairs import together

#: Spellings of a block, and of a slice of one, that are all compared at once.
COMMON = 100
RATIO = 0.8

#: Forms of the entity types, titles, and words of bodies' names.
PERSON_TYPES = ("person", "people", "researcher", "author", "scientist", "individual", "human")
BODY_TYPES = ("organisation", "organization", "org", "university", "company", "lab", "laboratory", "institution", "institute", "corporation", "agency")
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir", "phd", "dr-ing", "herr", "frau"}
SKIPPED = {"the", "of", "for", "and", "at", "in", "de", "la", "der", "fur", "ltd", "limited", "inc", "incorporated", "corp", "corporation", "llc", "gmbh", "co", "plc", "sa", "ag"}
BODY_WORDS = {
    "university": "univ uni", "institute": "inst", "technology": "tech technol", "research": "res rsrch", "laboratory": "lab labs laboratories", "national": "nat natl", "centre": "ctr cntr center cent", "computing": "comp comput",
    "analytics": "analyt", "department": "dept", "college": "coll", "academy": "acad", "school": "sch", "science": "sci sciences", "engineering": "eng engr", "international": "intl int", "association": "assoc assn", "society": "soc",
    "company": "comp", "group": "grp", "authority": "auth", "transport": "transp", "agency": "agcy", "foundation": "found fdn", "hospital": "hosp", "museum": "mus", "systems": "sys", "services": "serv svc", "studies": "stud", "medical": "med",
}
_SHORT = {s: w for w, ss in BODY_WORDS.items() for s in ss.split()} | {w: w for w in BODY_WORDS}
_FOLD = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ı": "i", "þ": "th", "ð": "d"})
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?|,|-")


def folded(text: str) -> str:
    """Without accents; case is kept."""
    plain = unicodedata.normalize("NFKD", text.translate(_FOLD))
    return "".join(c for c in plain if not unicodedata.combining(c)).translate(_FOLD)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def edits(a: str, b: str, most: int) -> int:
    """Edits and swaps of neighbours between a and b, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], before[j - 2] + 1)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def slips(size: int) -> int:
    """Most edits between two words, the longer of ``size`` letters."""
    return 3 if size >= 9 else 2 if size >= 7 else 1 if size >= 4 else 0


def alike(a: str, b: str) -> bool:
    """Whether two words differ by slips of the keyboard only."""
    if a == b:
        return True
    size = max(len(a), len(b))
    most = slips(size)
    return 2 * lcs(a, b) >= RATIO * (len(a) + len(b)) and edits(a, b, most) <= most


def person(name: str) -> dict | None:
    """family (letters only), parts, given, form (full, short or initial), initials."""
    tokens = [t for t in _TOKEN.findall(folded(name)) if t.rstrip(".").lower() not in TITLES]
    while tokens and tokens[0] in ",-":
        tokens.pop(0)
    words = [t for t in tokens if t not in ",-"]
    if not words:
        return None
    # Words joined by a hyphen stay one part of the name.
    parts: list[list[str]] = []
    joined = False
    comma = None
    for t in tokens:
        if t == ",":
            comma = len(parts) if comma is None and parts else comma
        elif t == "-":
            joined = bool(parts)
        else:
            if joined:
                parts[-1].append(t)
            else:
                parts.append([t])
            joined = False
    plain = ["".join(p) for p in parts]
    letters = [p.rstrip(".") for p in plain]
    shouted = letters[0].isupper() and len(letters[0]) > 3 and not all(x.isupper() for x in letters)
    initial = lambda x: len(x) == 1 or (len(x) <= 3 and x.isupper())
    if len(plain) == 1:
        family, given = parts, []
    elif comma:
        family, given = parts[:comma], parts[comma:]
    elif shouted:
        family, given = parts[:1], parts[1:]
    elif initial(letters[-1]) and not initial(letters[0]):
        n = len(plain)
        while n > 1 and initial(letters[n - 1]):
            n -= 1
        family, given = parts[:n], parts[n:]
    else:
        n = 1
        while n < len(plain) - 1 and initial(letters[n]):
            n += 1
        if initial(letters[0]):
            while n < len(plain) - 1 and initial(letters[n]):
                n += 1
        given, family = parts[:n], parts[n:]
    first = "".join(given[0]) if given else ""
    bare = first.rstrip(".")
    if not bare:
        form = "none"
    elif initial(bare) and (len(bare) == 1 or bare.isupper()):
        form = "initial"
    else:
        form = "short" if first.endswith(".") else "full"
    rest = "".join("".join(g).rstrip(".")[:1] for g in given[1:]).lower()
    initials = (bare.lower() if form == "initial" else bare[:1].lower()) + rest
    pieces = [x.rstrip(".").lower() for p in family for x in p]
    return {"family": "".join(pieces), "parts": pieces, "given": "" if form == "initial" else bare.lower(), "form": form, "initials": initials}


def body(name: str) -> dict | None:
    """family: the place or proper part; given: the kind of body, as words."""
    words = [w.rstrip(".").lower() for w in _TOKEN.findall(folded(name)) if w not in ",-"]
    words = [w for w in words if w not in SKIPPED]
    proper, kinds = [], []
    for w in words:
        known = _SHORT.get(w) or next((k for k in BODY_WORDS if len(w) >= 6 and alike(w, k)), None)
        if known:
            kinds.append(known)
        else:
            proper.append(w)
    if not proper:
        return None
    return {"family": "".join(sorted(proper)), "parts": proper, "given": " ".join(sorted(set(kinds))), "form": "body", "initials": ""}


def blocks(kind: str, family: str, given: str, form: str, formal: dict[str, frozenset]) -> set[str]:
    """The blocks of a spelling: of the family name, of the given names it may
    stand for, of the words of a kind of body."""
    if kind == "o":
        return {f"og{w}" for w in given.split()} or {"og"}
    full = {given, *formal.get(given, ())} if form == "full" else ()
    return {f"pf{family}", *(f"pg{x}" for x in full)}


def places(given: str, form: str, initials: str, formal: dict[str, frozenset]) -> set[str]:
    """Where a spelling stands in the block of its family name; two that are
    linked share a place, or their given names share a block."""
    if form == "none":
        return {"n"}
    if form == "initial":
        return {f"i{initials[:1]}"}
    found = {f"i{x[:1]}" for x in (given, *formal.get(given, ()))}
    if form == "full":
        found |= {f"s{given[-3:]}", *(f"d{x}" for x in shortened(given, 1))}
    return found


def shortened(word: str, most: int) -> set[str]:
    """The word without up to ``most`` of its letters. Words that differ by so
    many edits or swaps have one in common."""
    found = last = {word}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        found = found | last
    return found


def near_keys(family: str) -> set[str]:
    """Keys of which two families that are alike share one. A long family has
    too many shortened forms: of its seven segments, three edits or swaps leave
    one as it is, moved by three letters at most."""
    size = len(family)
    found = shortened(family, slips(size)) if size <= 20 else set()
    if size >= 18:
        for other in range(size - 3, size + 4):
            cuts = [i * other // 7 for i in range(8)]
            for i, (b, e) in enumerate(zip(cuts, cuts[1:])):
                found |= {f"{other}.{i}.{family[b + m : e + m]}" for m in range(-min(3, b), 4)}
    return found


_FIELDS = ("family", "given", "form", "initials")


def link(kind: str, a: tuple, b: tuple, formal: dict[str, frozenset], learned: bool) -> str | None:
    """strong, weak or None for two spellings (family, given, form, initials)."""
    fa, ga, forma, ia = a
    fb, gb, formb, ib = b
    if kind == "o":
        ka, kb = set(ga.split()), set(gb.split())
        fits = (ka <= kb or kb <= ka) and bool(ka & kb or not (ka | kb))
        return "strong" if fits and alike(fa, fb) and min(len(fa), len(fb)) >= 3 else None
    if not fa or not fb:
        return None
    if "none" in (forma, formb):
        return "strong" if forma == formb and fa == fb else None
    for x, y in ((ia[1:], ib[1:]),):
        if x and y and x[: len(y)] != y[: len(x)]:
            return None
    if "initial" in (forma, formb):
        if fa != fb:
            return None
        if forma == formb:
            return "weak" if ia[: len(ib)] == ib[: len(ia)] else None
        full = gb if forma == "initial" else ga
        letter = (ia if forma == "initial" else ib)[:1]
        return "weak" if letter in {full[:1], *(x[0] for x in formal.get(full, ()))} else None
    if "short" in (forma, formb):
        if fa != fb:
            return None
        if ga == gb:
            return "weak"
        s, full = (ga, gb) if len(ga) <= len(gb) else (gb, ga)
        return "weak" if full.startswith(s) or any(x.startswith(s) for x in formal.get(full, ())) else None
    same = ga == gb or bool(formal.get(ga, frozenset((ga,))) & formal.get(gb, frozenset((gb,)))) or learned
    if same:
        return "strong" if alike(fa, fb) else None
    if fa != fb:
        return None
    if _umlauts(ga) == _umlauts(gb) or (alike(ga, gb) and edits(ga, gb, 1) <= 1):
        return "strong"
    s, full = (ga, gb) if len(ga) <= len(gb) else (gb, ga)
    return "strong" if len(s) >= 3 and (full.startswith(s) or full.endswith(s)) else None


def _umlauts(word: str) -> str:
    return re.sub("([aou])e", r"\1", word)


def spellings(papers: DataFrame, extractions: DataFrame) -> DataFrame:
    """(name, kind): the distinct spellings of persons (p) and bodies (o)."""
    authors = papers.select(F.explode("authors").alias("name"), F.lit("p").alias("kind"))
    each = extractions.select(F.explode("entities").alias("e")).select(F.col("e.name").alias("name"), F.lower(F.trim(F.col("e.entity_type"))).alias("type"))
    kind = F.when(F.col("type").isin(*PERSON_TYPES), "p").when(F.col("type").isin(*BODY_TYPES), "o")
    return authors.unionByName(each.select("name", kind.alias("kind")).where("kind is not null")).where("name is not null and name <> ''").distinct()


def _strings(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in list(zip(*rows)) or [[]] * len(names)], names)


def _spread(df: DataFrame, columns: list[str], new: str, make) -> DataFrame:
    """Each row of strings with each of make(*columns) as ``new``."""
    old = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                c = batch.slice(first, 500).to_pydict()
                own = [make(*x) for x in zip(*(c[n] for n in columns))]
                yield _strings([(*r, x) for r, xs in zip(zip(*(c[n] for n in old)), own) for x in xs], [*old, new])

    return df.mapInArrow(run, ", ".join(f"`{n}` string" for n in [*old, new]))


def read(names: DataFrame) -> DataFrame:
    """The spellings with their parts; unlettered ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, k in zip(batch.column("name").to_pylist(), batch.column("kind").to_pylist()):
                p = person(n) if k == "p" else body(n)
                if p and p["family"]:
                    rows.append((n, k, *(p[f] for f in _FIELDS)))
            yield _strings(rows, ["name", "kind", *_FIELDS])

    return names.mapInArrow(run, "name string, kind string, family string, given string, form string, initials string")


def candidates(parsed: DataFrame, common: int = COMMON, formal: dict[str, frozenset] | None = None, learned: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of spellings, with every pair that is linked among them."""
    sent = parsed.sparkSession.sparkContext.broadcast(formal or {})
    named = parsed.select(F.concat("kind", "name").alias("id"), "kind", *_FIELDS)
    placed = _spread(named, ["kind", "family", "given", "form"], "block", lambda *x: blocks(*x, sent.value))
    if learned is not None:
        block = F.concat(F.lit("pl"), "item_a", F.lit("|"), "item_b")
        both = learned.select(block.alias("block"), F.explode(F.array("item_a", "item_b")).alias("given"))
        placed = placed.unionByName(named.where("kind = 'p' and form = 'full'").join(both, "given").select(*placed.columns))
    placed = written(placed)
    sizes = placed.groupBy("block").count()
    small = placed.join(sizes.where((F.col("count") > 1) & (F.col("count") <= common)).select("block"), "block", "left_semi").select("block", "id")
    large = written(placed.join(sizes.where(F.col("count") > common).select("block"), "block", "left_semi"))
    family = large.where("block like 'pf%'").select("id", "given", "form", "initials", "block")
    apart = _spread(family, ["given", "form", "initials"], "place", lambda *x: places(*x, sent.value)).select(F.concat_ws("|", "block", "place").alias("block"), "id")
    pairs = _compared(small.unionByName(apart), common).unionByName(_of_near_families(large.where("block not like 'pf%'").select("id", "family", "block")))
    return pairs.distinct()


def _compared(rows: DataFrame, common: int) -> DataFrame:
    """(a, b): all pairs of each block, a large one in slices, pair by pair."""
    rows = written(rows)
    sizes = rows.groupBy("block").count().where("count > 1").select("block", F.ceil(F.col("count") / common).cast("int").alias("slices"))
    own = rows.join(sizes, "block").withColumn("own", F.pmod(F.xxhash64("id"), "slices").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    own = own.select("block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id")
    a, b = (own.select("block", "low", "high", F.col("own").alias(f"own_{x}"), F.col("id").alias(x)) for x in "ab")
    return a.join(b, ["block", "low", "high"]).where("a < b and (low = high or own_a <> own_b)").select("a", "b")


def _of_near_families(large: DataFrame) -> DataFrame:
    """(a, b): pairs of one block whose family names are alike."""
    families = written(large.select("block", "family").distinct().withColumn("no", F.monotonically_increasing_id()))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                rows = [(n, f"{block}|{k}") for block, family, n in zip(*batch.slice(first, 500).to_pydict().values()) for k in near_keys(family)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * 2, (pa.int64(), pa.string()))], ["no", "key"])

    # Spark takes the keys to be as few as the families, and would send them all.
    tasks = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = families.repartition(tasks, "no").mapInArrow(keyed, "no long, key string").select(F.xxhash64("key").alias("key"), "no")
    a, b = (found.select("key", F.col("no").alias(x)) for x in ("no", "other_no"))
    met = a.join(b.hint("merge"), "key").where("no < other_no").select("no", "other_no").distinct().join(families, "no")
    met = met.join(families.select(F.col("no").alias("other_no"), "block", F.col("family").alias("other")), ["other_no", "block"]).select("block", "family", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            yield _strings([x for x in zip(c["block"], c["family"], c["other"]) if alike(*x[1:])], ["block", "family", "other"])

    near = written(met.mapInArrow(run, "block string, family string, other string").unionByName(families.select("block", "family", F.col("family").alias("other"))))
    a = large.select("block", "family", F.col("id").alias("x"))
    b = large.select("block", F.col("family").alias("other"), F.col("id").alias("y"))
    return a.join(near, ["block", "family"]).join(b, ["block", "other"]).where("family <> other or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def learned_pairs(parsed: DataFrame) -> DataFrame:
    """(item_a, item_b): given names that go with the same family names."""
    cells = parsed.where("kind = 'p' and form = 'full' and length(given) >= 3").select(F.col("family").alias("record"), F.col("given").alias("item")).distinct()
    found = together(cells, 2, 8)
    return found.where(F.col("n_ab") * 2 >= F.least("n_a", "n_b")).select("item_a", "item_b")


def links(parsed: DataFrame, pairs: DataFrame, nicknames: dict[str, frozenset], learned: DataFrame) -> DataFrame:
    """(a, b, strength) of the candidate pairs that fit."""
    fields = parsed.select(F.concat("kind", "name").alias("id"), *_FIELDS)
    left = fields.select(*(F.col(c).alias({"id": "a"}.get(c, f"{c}_a")) for c in fields.columns))
    right = fields.select(*(F.col(c).alias({"id": "b"}.get(c, f"{c}_b")) for c in fields.columns))
    known = learned.select(F.col("item_a").alias("low"), F.col("item_b").alias("high"), F.lit(True).alias("learned"))
    full = pairs.join(left, "a").join(right, "b").withColumns({"low": F.least("given_a", "given_b"), "high": F.greatest("given_a", "given_b")}).join(known, ["low", "high"], "left")
    sent = parsed.sparkSession.sparkContext.broadcast(nicknames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            rows = []
            for i, (a, b) in enumerate(zip(c["a"], c["b"])):
                if a[0] == b[0]:
                    s = link(a[0], tuple(c[f"{f}_a"][i] for f in _FIELDS), tuple(c[f"{f}_b"][i] for f in _FIELDS), sent.value, bool(c["learned"][i]))
                    if s:
                        weak = [c[f"form_{x}"][i] in ("initial", "short") for x in "ab"]
                        rows.append((a, b, s, *weak))
            kinds = [pa.string()] * 3 + [pa.bool_()] * 2
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds)], ["a", "b", "strength", "weak_a", "weak_b"])

    return full.select("a", "b", *(f"{f}_{x}" for x in "ab" for f in _FIELDS), "learned").mapInArrow(run, "a string, b string, strength string, weak_a boolean, weak_b boolean")


def clusters(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """(id, label) of every linked spelling."""
    found = written(found)
    strong = components(found.where("strength = 'strong'"))
    # A strong spelling without any strong link is a person of its own.
    weak = found.where("strength = 'weak'")
    one = weak.where("weak_a <> weak_b").select(F.when(F.col("weak_a"), F.col("a")).otherwise(F.col("b")).alias("w"), F.when(F.col("weak_a"), F.col("b")).otherwise(F.col("a")).alias("node"))
    fits = one.join(strong, "node", "left").select("w", F.coalesce("label", "node").alias("label")).distinct()
    owner = fits.groupBy("w").agg(F.count("*").alias("n"), F.min("label").alias("label"))
    joined = written(owner.where("n = 1").select(F.col("w").alias("node"), "label"))
    hosts = joined.select(F.col("label").alias("node"), "label").distinct().join(strong.select("node"), "node", "left_anti")
    free = weak.where("weak_a and weak_b").join(owner.select(F.col("w").alias("a")), "a", "left_anti").join(owner.select(F.col("w").alias("b")), "b", "left_anti")
    alone = components(free)
    return strong.unionByName(joined).unionByName(hosts).unionByName(alone).select(F.col("node").alias("id"), "label")


def linked(papers: DataFrame, extractions: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(name, kind, label): every linked spelling with its class."""
    formal: dict[str, set] = {}
    for r in bounded_rows(nicknames.select("given", "nick").where("given is not null and nick is not null"), "the table of nicknames"):
        given, nick = folded(r.given).lower(), folded(r.nick).lower()
        formal.setdefault(nick, {nick}).add(given)
        formal.setdefault(given, {given})
    parsed = written(read(spellings(papers, extractions)))
    learned = written(learned_pairs(parsed))
    short = {k: frozenset(v) for k, v in formal.items()}
    found = links(parsed, candidates(parsed, COMMON, short, learned), short, learned)
    return clusters(parsed, found).select(F.expr("substring(id, 2)").alias("name"), F.expr("left(id, 1)").alias("kind"), "label")


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(*(table(spark, sf_dir, t) for t in ("papers", "extractions", "nicknames")))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each linked spelling, with its class and the class's size."""
    rows = written(_linked(spark, sf_dir))
    return rows.join(rows.groupBy("label").agg(F.count("*").alias("spellings")), "label").select("name", "kind", F.expr("substring(label, 2)").alias("class_name"), "spellings")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(_linked(spark, sf_dir))
    a, b = (rows.select("label", F.col("name").alias(f"name_{x}")) for x in "ab")
    return a.join(b, "label").where("name_a < name_b").select("name_a", "name_b").distinct()


def p6_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct spellings of persons (p) and bodies (o) that are compared."""
    return spellings(*(table(spark, sf_dir, t) for t in ("papers", "extractions")))


QUERIES = {"p6_spellings": p6_spellings, "p6_classes": p6_classes, "p6_found": p6_found}
_IN = "lower(trim(e.entity_type)) IN ({})"
_QUOTED = [", ".join(f"'{t}'" for t in types) for types in (PERSON_TYPES, BODY_TYPES)]
SQL = {
    "p6_spellings": f"""
WITH each AS (SELECT unnest(entities) AS e FROM extractions),
named AS (
  SELECT unnest(authors) AS name, 'p' AS kind FROM papers
  UNION ALL SELECT e.name, 'p' FROM each WHERE {_IN.format(_QUOTED[0])}
  UNION ALL SELECT e.name, 'o' FROM each WHERE {_IN.format(_QUOTED[1])}
)
SELECT DISTINCT name, kind FROM named WHERE name <> ''
"""
}
