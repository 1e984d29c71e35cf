"""Language, quality and page models: their mathematics, edge cases and held-out results."""

import random

import numpy as np
import pytest

from entityops.llm import html_blocks, language, mil_quality

LANGUAGES = {"aa": "abcde fghi", "bb": "klmno pqrs", "cc": "tuvwx yzab"}


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(LANGUAGES))
        out.append((i, "".join(rng.choices(LANGUAGES[lang], k=rng.randint(20, 300))), lang, "x"))
    return out


def test_languages_by_prototypes(spark):
    schema = "doc_id long, text string, lang string, score string"
    train = spark.createDataFrame([*texts(1, 60), (900, None, "aa", ""), (901, "klm", None, "")], schema)
    prototypes = language.fit(train)
    assert list(prototypes) == ["aa", "bb", "cc"]
    rows = [*texts(2, 60), (100, None, "aa", ""), (101, "", None, ""), (102, "12 34 !?", "bb", ""), (103, "KLmno", "bb", ""), (104, "abc " * 40000, "aa", ""), (0, texts(2, 1)[0][1], "q", "")]
    got = language.predict(spark.createDataFrame(rows, schema), prototypes).collect()
    assert len(got) == len(rows)
    for row in got:
        if row.doc_id < 100 and row.lang != "q":
            assert row.lang_pred == row.lang
        assert 0 <= row.score <= 1
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "bb", "aa"]
    assert language.predict(spark.createDataFrame([], schema), prototypes).count() == 0
    nothing = language.fit(spark.createDataFrame([], schema))
    assert nothing == {} and language.predict(train.limit(1), nothing).first().lang_pred == "und"


def test_bundles_are_sums_of_bound_letters():
    space = language.Space(dimensions=64, remembered=3)
    memory = language.Memory(space)
    codes, counts = language.grams("Abc-abd abc", 3)
    want = np.zeros(64)
    text = " abc abd abc "
    for i in range(len(text) - 2):
        a, b, c = (memory.letter(ord(x)).astype(int) for x in text[i : i + 3])
        want += np.roll(a, 2) * np.roll(b, 1) * c
    for _ in range(3):  # remembered vectors give the same sum
        assert (memory.bundle(codes, counts) == want).all()
    assert memory.used == 3


def test_attention_gradient():
    settings = mil_quality.Settings(hidden=5, gate=4)
    draw = np.random.default_rng(0)
    x, first, y = draw.standard_normal((9, 6)).astype(np.float32), np.array([0, 4, 5, 9]), np.array([1, 0, 1], dtype=np.float32)
    model = {k: v.astype(np.float64) for k, v in mil_quality.start(6, settings).items()}

    def loss(m):
        p = mil_quality.forward(m, x, first)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    check_gradient(loss, model, mil_quality.gradient(model, x, first, y))


def check_gradient(loss, model, grad):
    for name, values in model.items():
        for place in range(0, values.size, max(1, values.size // 5)):
            low, high = ({**model, name: values.copy()} for _ in range(2))
            low[name].flat[place] -= 1e-5
            high[name].flat[place] += 1e-5
            assert grad[name].flat[place] == pytest.approx((loss(high) - loss(low)) / 2e-5, abs=2e-4), name


def test_passages_cover_whole_texts():
    settings = mil_quality.Settings(passage_words=4)
    x, first = mil_quality.passages([b"", b"a b c d e", b" \n", b"Same same same same"], settings)
    assert first.tolist() == [0, 1, 3, 4, 5] and not x[0].any() and not x[3].any()
    dense = len(mil_quality.KINDS) + 1
    assert x[1, dense] == pytest.approx(np.log1p(4) / 5) and x[2, dense] == pytest.approx(np.log1p(1) / 5)
    assert x[4, dense + 3] == pytest.approx(0.5) and x[4, dense + 4] == pytest.approx(0.75)


def test_quality_scores(spark):
    rng = random.Random(4)
    good = lambda: " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 7))) for _ in range(rng.randint(30, 200)))
    bad = lambda: good().replace(" ", "### ")
    rows = [(i, (good if i % 3 else bad)(), "old") for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None, ""), (901, "", ""), (902, good() * 200, ""), (5, rows[5][1], "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(3, 1), (5, None), (None, 1), (5000, 0)], "doc_id long, quality int")
    settings = mil_quality.Settings(epochs=12)
    got = mil_quality.score(docs, mil_quality.fit(docs, labels, settings), settings).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if 200 <= r.doc_id < 300]
    assert sum((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in held) >= 97
    assert next(r for r in got if r.doc_id == 902).score > 0.5
    empty = labels.where("doc_id < 0")
    assert mil_quality.score(docs, mil_quality.fit(docs, empty)).first().score == 0.5
    assert mil_quality.score(docs.where("doc_id < 0"), 0.5).count() == 0


PAGE = (
    "<!DOCTYPE html><html><head><title>x</title><script>var a='</p>'</script></head><body><nav><ul><li><a href='/a?b>c'>menu</a></li></ul></nav>"
    "<div class='ad'>buy now</div><article><h1>A &amp; B</h1><p>First  line,\n with<b> bold</b> text.<p>Second &eacute; paragraph of the text.<br>more</p></article>"
    "<section class='comments'><p>nice one</p></section><footer>&copy; someone</footer></body></html>"
)


def test_blocks_of_a_page():
    found = html_blocks.blocks(PAGE)
    assert [b.text for b in found] == ["menu", "buy now", "A & B", "First line, with bold text.", "Second é paragraph of the text. more", "nice one", "© someone"]
    assert found[0].linked == 4 and found[1].path[-2:] == ("div", ".ad") and found[4].path[-1] == "p" and found[4].path.count("p") == 1
    assert html_blocks.blocks(None) == html_blocks.blocks("") == []
    assert [b.text for b in html_blocks.blocks("<p>a < b <p class='x>unclosed")] == ["a < b <p class='x>unclosed"]


def test_recurrent_gradient():
    settings = html_blocks.Settings(hidden=3)
    model = {k: v.astype(np.float64) for k, v in html_blocks.start(settings).items()}
    draw = np.random.default_rng(1)
    x = draw.standard_normal((4, 2, html_blocks.PATH + html_blocks.WORDS + html_blocks.DENSE))
    live = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], dtype=bool)
    y = np.array([[1, 0], [0, 1], [1, 0], [1, 0]])

    def loss(m):
        p = html_blocks._labels(m, x, live)[0]
        return -np.mean(np.where(y, np.log(p), np.log(1 - p))[live])

    check_gradient(loss, model, html_blocks.gradient(model, x, live, y))


def test_main_text(spark):
    long = PAGE.replace("First", "word " * 30000 + "First")
    rows = [(1, "u", PAGE, 1), (2, "u", None, 2), (3, None, "", 3), (4, "u", long, 4), (1, "u", PAGE, 1), (5, "u", "<nav>only a menu</nav>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    settings = html_blocks.Settings()
    model = html_blocks.fit(pages, settings)
    got = html_blocks.main_text(pages, model, settings).collect()
    by_id = {r.page_id: r for r in got}
    want = "A & B\nFirst line, with bold text.\nSecond é paragraph of the text. more"
    assert len(got) == 6 and by_id[1].text == want and by_id[1].n_chars == len(want) and set(got[0].asDict()) == {"page_id", "url", "html", "text", "n_chars"}
    assert by_id[2].text == by_id[3].text == "" and by_id[4].n_chars == len(want) + 150000
    draw = np.random.default_rng(77)
    stock = [f"some words number {i} to fill a page with text." for i in range(50)]
    right = total = 0
    for _ in range(60):
        found = html_blocks.blocks(html_blocks.training_page(draw, stock))
        truth = [b.text.startswith("\x02") for b in found]
        for b in found:
            b.text = b.text.lstrip("\x02") or "x"
        right += (((html_blocks._labels(model, *html_blocks._padded([html_blocks.features(found)]))[0][:, 0]) >= 0.5) == truth).sum()
        total += len(truth)
    assert right / total > 0.97
    assert html_blocks.main_text(pages.limit(0), model, settings).count() == 0
