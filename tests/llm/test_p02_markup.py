import itertools
import random

import numpy as np
import pytest

from scholaspark.llm import p02_markup as p2


@pytest.fixture(scope="module")
def model():
    return p2.train()


def test_held_out_pages(model):
    rng = random.Random(404)
    right = 0
    for _ in range(300):
        text, marked = p2._page(rng)
        right += set(p2.kinds_of(text, model)) == {k for *_, k in marked}
    assert right >= 0.95 * 300


def test_marginals_equal_those_by_enumeration(model):
    text = "A **b c** d and _e f_.\n\nIt is 3 * 4 * 5 there.\n\n# h i\n\nplain"
    found = p2.spans(text)
    roots, each = model.marginals(text, found)
    k = p2.KINDS.index("markdown")
    begins = p2.blocks(text)
    own = [s for s in found if s.kind == "markdown"]
    at = np.searchsorted(begins, [s.begin for s in own], "right") - 1
    used = sorted(set(at.tolist()))
    empty = (len(begins) - len(used)) * np.log(model.none[k] @ model.block[k].T)
    empty = np.clip(empty - empty.max(), -1, 0)
    total, on_root, on_span = 0.0, 0.0, np.zeros(len(own))
    for states in itertools.product((0, 1), repeat=1 + len(used) + len(own)):
        root, blocks, marks = states[0], dict(zip(used, states[1:])), states[1 + len(used) :]
        p = model.prior[k, root] if model.prior.ndim == 2 else 0
        p *= np.exp(empty[root])
        for x in blocks.values():
            p *= model.block[k, root, x] * (1 - model.none[k, x])
        for s, b, y in zip(own, at, marks):
            p *= model.span[k, blocks[int(b)], y] * model.form[("markdown", s.form)][y]
        total += p
        on_root += p * root
        on_span += p * np.array(marks)
    assert roots["markdown"] == pytest.approx(on_root / total)
    assert [p for s, p in zip(found, each) if s.kind == "markdown"] == pytest.approx((on_span / total).tolist())


def test_clean_text_keeps_structure(model):
    text = "<h2>Old roads</h2>\n<p>The <b>road</b> &amp; the bridge.</p>\n<ul>\n<li>one</li>\n<li>two</li>\n</ul>\n<pre><code>for x in y:\n    f(x)\n</code></pre>\n<table><tr><td>a</td><td>5</td></tr></table>"
    kinds, plain, blocks = p2.clean(text, model)
    assert kinds == ["html"]
    assert blocks == [("heading", "Old roads"), ("paragraph", "The road & the bridge."), ("list", "one"), ("list", "two"), ("code", "for x in y:\n    f(x)"), ("table", "a | 5")]
    assert plain == "Old roads\n\nThe road & the bridge.\n\n- one\n- two\n\nfor x in y:\n    f(x)\n\na | 5"
    text = "\\section{Old roads}\nThe \\emph{road} is long \\cite{a1}.\n\n\\begin{equation}\nx_{t} = \\alpha\n\\end{equation}\n\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}"
    assert p2.clean(text, model)[2] == [("heading", "Old roads"), ("paragraph", "The road is long."), ("formula", "x_{t} = \\alpha"), ("list", "one"), ("list", "two")]
    text = "# Old roads\n\nThe **road** is [long](http://x.example/1).\n\n- [x] one\n- [ ] two\n\n```\nf(x)\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |"
    assert p2.clean(text, model)[2] == [("heading", "Old roads"), ("paragraph", "The road is long."), ("list", "one"), ("list", "two"), ("code", "f(x)"), ("table", "a | b"), ("table", "1 | 2")]
    text = "== Old roads ==\nThe '''road''' is [[Long way|long]].\n* [[one]]\n\n{{main|two}} End."
    assert [b for _, b in p2.clean(text, model)[2]][:2] == ["Old roads", "The road is long."]


@pytest.mark.parametrize("text", ["It costs $40 to $74 per run.", "With R^2 = 0.9 and x_1 fixed, it is 3 * 7.", "The file is under data\\raw\\notes and ~24% of it is used.", "It holds for p < 0.06 and for q > 2 alike.", "The R&D group used C++ and {a, b} as states.", "As noted in [7], it is item #12.", "Keep in mind:\n• one\n• two", "", "   \n"])
def test_no_markup(model, text):
    assert p2.clean(text, model)[:2] == ([], text)


def test_defined_results(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "", 1), ("c", "<b>x</b> y " * 20000, 1), ("c", "<b>x</b> y " * 20000, 2), (None, "# t\n\nx", 1)], "k string, text string, markup int")
    assert sorted((r.record_key or "", r.markup) for r in p2.markup(df, "chunk", "k", "text").distinct().collect()) == [("", "markdown"), ("c", "html")]
    assert p2.cleaned(df, "chunk", "k", "text").count() == 5
    assert p2.markup(df.limit(0), "chunk", "k", "text").count() == 0


def test_long_constructs_are_found(model):
    word = "word " * 70
    cases = [
        (f'A map: <img alt="x" src="data:{"a" * 400}"> of it.', ["html"], "A map: of it."),
        ("So \\[ " + "x_i + y_i + " * 130 + "z \\] holds.", ["latex"], None),
        ("Let $" + "x_i + " * 80 + "z$ be.", ["latex"], None),
        (f"The **{word}end** is.", ["markdown"], f"The {word}end is."),
        ("Then\n$$\nx^2 + y^2\n$$\nso.", ["latex"], "Then\n\nx^2 + y^2\n\nso."),
        (f"See [it](http://x.example/{'y' * 600}).", ["markdown"], "See it."),
        (f"The '''{word}end''' of ''{word}it''.", ["wiki"], f"The {word}end of {word}it."),
        (f"A note.\\footnote{{{word}end}}", ["latex"], None),
        ("{{Infobox town\n| name = Old town\n| size = 7\n}}\nThe town.", ["wiki"], "The town."),
    ]
    for text, kinds, plain in cases:
        found = p2.clean(text, model)
        assert p2.kinds_of(text, model) == kinds == found[0], text[:40]
        assert plain is None or found[1] == plain
        assert not any(sign in found[1] for sign in ("<img", "\\[", "$", "**", "](", "''", "{{", "\\footnote"))


def test_openings_without_end_take_linear_time(model):
    import time

    for sign in ("\\(", "<!--", "[a](", "'''a", "$a ", "\\begin{align}", "> - ", "{{a", "**a "):
        took = []
        for n in (4_000, 16_000):
            began = time.process_time()
            p2.kinds_of(sign * n, model)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5


def test_prices_and_signs_are_no_formulas(model):
    for text in ("It costs $5 and $7 per unit, at " + "a fair " * 60 + "$9.", "It costs $$ and the others $$ too.", "$$ %% ## $$"):
        assert p2.kinds_of(text, model) == []
