import random

import pytest

from scholaspark.llm import p05_scans as p5

VOCABULARY = ["modern", "burning", "examples", "climate", "within", "settle", "betting", "window", "calendar", "defined", "duplicate", "minimal", "between"]


def by_trying(word, words, budget):
    """Originals within the budget of confusions, by writing all of them."""
    swaps = [(a.lower(), b.lower()) for a, b in p5.CONFUSIONS]
    found = {}
    for w in words:
        level = {(w, 0)}
        for cost in range(1, budget + 1):
            new = set()
            for t, start in level:
                for printed, read in swaps:
                    at = t.find(printed, start)
                    while at >= 0:
                        new.add((t[:at] + read + t[at + len(printed) :], at + len(read)))
                        at = t.find(printed, at + 1)
            if any(t == word for t, _ in new):
                found.setdefault(w, cost)
            level = new
    found.pop(word, None)
    return found


@pytest.mark.parametrize("word", ["modem", "bumning", "examp1es", "cllmate", "durlng", "wlthln", "betvveen", "rninimal", "duphcate", "ca1enclar", "defmed", "betfing", "bettinq", "window"])
def test_candidates_are_complete(word):
    trie = p5.Trie([(w, 9) for w in VOCABULARY])
    got = {o: c for o, (c, pure, _) in trie.candidates(word).items() if pure}
    assert got == by_trying(word, VOCABULARY, 2)


def test_one_edit_is_found():
    trie = p5.Trie([(w, 9) for w in VOCABULARY])
    rng = random.Random(8)
    for w in VOCABULARY:
        for _ in range(10):
            at = rng.randrange(len(w))
            typo = rng.choice([w[:at] + "x" + w[at:], w[:at] + w[at + 1 :], w[:at] + "x" + w[at + 1 :]])
            assert typo == w or w in trie.candidates(typo)


PAGE = "The old mill\n\nAbstract\nThe mill stood at the river for a long time, and no one\nremem-\np. 54\nRiver Notes, Vol. 3\nbered who had built it. The stones of the mi1l were taken\n– 55 –\nRIVER NOTES, VOL. 3\nfrom the hills near the river.\n\n1 History\nRiver Notes, Vol. 3\nThe first mention of the mill is found in a letter of the\nabbot, which tells of a dispute over the water-\nways. It was settled."


def test_layout():
    layout = p5.Layout(PAGE)
    assert layout.counts() == {"header": 3, "page_number": 2} and layout.wrapped
    assert [(a, b) for _, _, a, b in layout.breaks] == [("remem", "bered"), ("water", "ways")]
    fixed = p5.repair(PAGE, {"mi1l": [("mill", 1, 50, True), ("mil", 2, 90, True)]})
    assert fixed.split("\n\n") == [
        "The old mill", "Abstract", "The mill stood at the river for a long time, and no one remembered who had built it. The stones of the mill were taken from the hills near the river.",
        "1 History", "The first mention of the mill is found in a letter of the abbot, which tells of a dispute over the waterways. It was settled.",
    ]


@pytest.mark.parametrize("text", ["Scores by run:\n50\n88\n87", "One line only.", "a\nb\nc", "<ul>\n<li>x</li>\n</ul>\n\n<ul>\n<li>y</li>\n</ul>"])
def test_no_noise(text):
    layout = p5.Layout(text)
    assert not any(layout.furniture) and not layout.breaks and p5.repair(text, {}) == text


def test_found_and_blocks_agree(spark, monkeypatch):
    clean = " ".join(f"{a} {b}" for a in VOCABULARY for b in VOCABULARY)
    rows = [(f"c{i}", None, clean, None, 1) for i in range(30)]
    lines = ["modem examples of the cllmate shown", "in the ca1enclar betvveen the modern", "windows and the wlthin of a river", "that flows in the valley of stones"]
    rows += [("s1", None, "\n".join(lines * 2), [("h", None)], 1), ("s1", None, "\n".join(lines * 2), [("h", None)], 2), ("s2", "t", None, [("h", PAGE), ("h", "")], 1), ("n", None, None, None, 1), ("e", "", "", [], 1), ("l", None, "word " * 100000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id string, title string, full_text string, sections array<struct<heading string, text string>>, noise int")
    want = {("s1", "full_text", "misread"), ("s2", "sections", "header"), ("s2", "sections", "page_number"), ("s2", "sections", "hyphenation")}
    assert {tuple(r) for r in p5.noise(df).collect()} == want
    monkeypatch.setattr(p5.candidates, "__defaults__", (4, 3))
    assert {tuple(r) for r in p5.noise(df).collect()} == want
    fixed = {r.doc_id: r for r in p5.repaired(df).collect()}
    assert "modern examples of the climate shown in the calendar between" in fixed["s1"].full_text and fixed["n"].full_text is None and fixed["e"].full_text == ""
    assert p5.noise(df.limit(0)).count() == 0


def test_a_word_divided_twice_counts_twice(spark):
    text = "the stones of the water-\nways near the old river\nand then the water-\nways of the valley"
    rows = [("d", None, text, None), ("d", None, text, None), ("e", None, text.split("\nand")[0], None), ("e", None, text.split("\nand")[0], None)]
    df = spark.createDataFrame(rows, "doc_id string, title string, full_text string, sections array<struct<heading string, text string>>")
    assert {tuple(r) for r in p5.noise(df).collect()} == {("d", "full_text", "hyphenation")}


FIELDS = "doc_id string, title string, full_text string, sections array<struct<heading string, text string>>"


def noisy(spark, texts, clean, times):
    rows = [(f"c{i}", None, clean, None) for i in range(times)] + [(k, None, t, None) for k, t in texts.items()]
    df = spark.createDataFrame(rows, FIELDS)
    found = {r.record_key for r in p5.noise(df).collect() if r.noise == "misread"}
    fixed = {r.doc_id: r.full_text for r in p5.repaired(df).collect()}
    return found, fixed


def test_short_words_and_other_edits_count_beside_a_sure_one(spark, monkeypatch):
    clean = "the measurement of the modern climate for the window was low"
    texts = {"a": "tbe measuremant of modem", "b": "a measureent for tbe c1imate", "d": "mersurement l0w cllmate", "e": "tbe measuremant for", "f": "measurements tbe modem", "g": "an old measuremant"}
    for limit in (p5.BROADCAST_LIMIT, 0):
        monkeypatch.setattr(p5, "BROADCAST_LIMIT", limit)
        found, fixed = noisy(spark, texts, clean, 200)
        # Without a sure word nothing counts; an ending is no misreading.
        assert found == {"a", "b", "d"}
        assert fixed["a"] == "the measurement of modern" and fixed["b"] == "a measurement for the climate" and fixed["d"] == "measurement low climate"
        assert fixed["e"] == texts["e"] and fixed["g"] == texts["g"] and fixed["f"] == "measurements the modern"


def test_a_steady_misreading_is_found_wherever_it_stands(spark):
    clean = "modern climate examples of the window within the calendar"
    texts = {f"s{i}": "modem cllmate exarnples of the wlndow" for i in range(6)}
    for parts in (1, 7):
        rows = [(f"c{i}", None, clean, None) for i in range(70)] + [(k, None, t, None) for k, t in texts.items()]
        df = spark.createDataFrame(rows, FIELDS).repartition(parts, "doc_id")
        assert {r.record_key for r in p5.noise(df).collect()} == set(texts)


def test_a_word_visits_the_bins_of_its_originals():
    rng = random.Random(2)
    trie = p5.Trie([(w, 9) for w in VOCABULARY])
    for word in ("modem", "bumning", "examp1es", "cllmate", "wlthln", "betvveen", "rninimal", "duphcate", "ca1enclar", "lietween", "vvindovv"):
        for number in (1, 7, 500):
            own = set(p5.bins_of(word, True, number))
            for original, (_, pure, _) in trie.candidates(word).items():
                assert not pure or own & set(p5.bins_of(original, False, number))
    for w in VOCABULARY:
        at = rng.randrange(2, len(w) - 2)
        assert set(p5.bins_of(w[:at] + "x" + w[at + 1 :], True, 500)) & set(p5.bins_of(w, False, 500))
