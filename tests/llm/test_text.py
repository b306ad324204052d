"""Look-alikes, encodings, markup: small cases, properties, and what each does with nulls, blanks and repeats."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bookspark.llm import encodings as enc
from bookspark.llm import lookalikes as look
from bookspark.llm import markup

SAMPLES = {"en": ["The café of the old harbour", "It was the surveyor’s ledger that the slow miller hid", "“Have you seen the bridge?” asked the nurse"] * 4, "de": ["Für Hanna war der Hafen größer als der kühle Garten", "Über den Käfer nach Süden", "Die Häuser von Köln"] * 4, "fr": ["La lumière étroite brûlait déjà derrière la forêt", "L’été à la rivière", "Âge d’or à la cathédrale oubliée"] * 4, "ru": ["Новый мост камня: роман", "Там был старый берег, и никто не искал его", "За окном стоял тихий учитель"] * 4}


@pytest.fixture(scope="module")
def model():
    return enc.model(enc.dictionaries_from(SAMPLES))


@pytest.mark.parametrize("text", ["La lumière étroite brûlait déjà", "Für Hanna war der Garten größer", "Там был старый берег"])
@pytest.mark.parametrize("wrong", ["cp1252", "cp1251", "cp437", "mac_roman", "cp850"])
def test_round_trip(model, text, wrong):
    damaged = "".join(enc._chars_of(wrong)[b] for b in text.encode())
    got = model.repair(damaged)
    assert got and got[0] == text


@pytest.mark.parametrize("text", ["Zażółć gęślą jaźń w mieście", "Příliš žluťoučký kůň", "İstanbul’da güneşli bir gün", "Το παλιό λιμάνι της νήσου", "古い港の地図"])
def test_languages_that_no_sample_holds(model, text):
    """A language is not known from a list: UTF-8 read as something else is restored whatever the language."""
    for wrong in ("cp1252", "cp850"):
        damaged = "".join(enc._chars_of(wrong)[b] for b in text.encode())
        got = model.repair(damaged)
        # of two like code pages only a sample of the language could tell which it was
        assert got and (got[0] == text or wrong == "cp850")


def test_samples_are_weeded():
    """Frequent damage leaves no trace in the models: the commoner form of its neighbours is at hand."""
    clean = [f"El faro de la mañana {k}" for k in range(200)]
    bad = [f"El faro de la maÃ±ana {k}" for k in range(20)]
    assert enc.weeded({"es": clean + bad})["es"] == clean


def test_double_and_one_byte(model):
    once = "".join(enc._chars_of("cp1252")[b] for b in "Über den Käfer".encode())
    twice = "".join(enc._chars_of("cp1252")[b] for b in once.encode())
    assert model.repair(twice)[0] == "Über den Käfer"
    assert model.repair("Там был старый берег".encode("cp1251").decode("cp1252"))[0] == "Там был старый берег"


@pytest.mark.parametrize("text", ["Café of the harbour", "Für Hanna", "Там был старый берег", "L’été à la rivière", "The β-Signal", "CORAÇÃO DE OURO", "plain", ""])
def test_clean_stays(model, text):
    assert model.repair(text) is None


def test_encoding_operator(spark):
    m = spark.createDataFrame([("a", "CafÃ© of the harbour", None, "en", 1), ("a", "CafÃ© of the harbour", None, "en", 1), ("b", None, "", None, 2), ("c", "lost � sign", " ".join(f"grÃ¼n{i * 7919 % 10007}" for i in range(6000)), "en", 3)] + [(f"k{i}", f"Café number {i} für den Hafen", "Das Café war schön.", "en", 4) for i in range(6)], "book_id string, title string, description string, language string, tbl int")
    w = spark.createDataFrame([(1, "fÃ¼r"), (2, None), (3, "")], "warning_id bigint, message string")
    got = {(r.tbl, r.row_key, r.field) for r in enc.found(m, w).collect()}
    assert ("metadata", "a", "title") in got and ("metadata", "c", "title") in got and ("metadata", "c", "description") in got and ("warnings", "1", "message") in got
    assert not {k for k in got if k[1] in ("b", "2", "3") or k[1][0] == "k"}
    assert enc.found(m.limit(0), w.limit(0)).count() == 0


TITLES = "book_id string, title string, description string, language string"


def test_models_count_every_sentence(spark):
    """A pair of neighbours in 6 of 4000 titles is usual, one in a single title is not."""
    letters = "àáâãäåæçèéêë"
    rows = [(str(k), f"{' '.join(letters)} {k}", None, "xx") for k in range(4000)]
    for i, (a, b) in enumerate(zip(letters, letters[1:], strict=False)):
        rows[10 * i:10 * i + 6] = [(f"{i}-{k}", f"{' '.join(letters)} {a}{b} {k}", None, "xx") for k in range(6)]
    rows[-1] = ("last", f"{' '.join(letters)} ëà", None, "xx")
    known = enc.Model(enc.fit(spark.createDataFrame(rows, TITLES))).neighbours
    assert {a + b for a, b in zip(letters, letters[1:], strict=False)} <= known and "ëà" not in known


def test_no_language_is_left_out(spark):
    """The language with the least text of eighteen has a model as well."""
    rows = [(f"{lang}{k}", f"The long café of the old harbour and the quiet river number {k}", None, lang) for lang in "aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp qq".split() for k in range(40)]
    rows += [(f"ru{k}", f"Там был старый берег {k}", None, "ru") for k in range(40)] + [("bad", "Там был старый берег".encode("cp1251").decode("cp1252"), None, "ru")]
    got = enc.restore(spark.createDataFrame(rows, TITLES), spark.createDataFrame([], "warning_id bigint, message string")).collect()
    assert [(r.row_key, r.restored) for r in got] == [("bad", "Там был старый берег")]


def test_models_count_plain_bracketed_and_short_texts(spark):
    """Words of plain sentences are known, a language without a foreign letter is no error, and titles in brackets or of three letters count."""
    rows = [(f"p{k}", f"the quiet orchard {k}", None, "en") for k in range(60)] + [(f"q{k}", f"le café {k}", None, "en") for k in range(5)] + [(f"n{k}", f"harbour lights {k}", None, "nl") for k in range(60)]
    rows += [(f"b{k}", f"[øre {k}]", None, "da") for k in range(60)] + [(f"s{k}", "Žár", None, "cs") for k in range(60)]
    made = enc.fit(spark.createDataFrame(rows, TITLES))
    words = {w for d in made for w in d.decode().split()}
    assert {"quiet", "orchard", "harbour"} <= words and {"[ø", " ž", "žá", "áa"} <= enc.Model(made).neighbours


LOOK = [
    ("Thе Old Map", ["script"]), ("Νicholas", ["script"]), ("a\u200bb", ["invisible"]), ("a\u00a0b", ["space"]), ("Ｔｈｅ", ["form"]), ("ﬁne", ["form"]), ("cafe\u0301", ["decomposed"]), ("x&nbsp;y", ["space"]), ("x&#8203;y", ["invisible"]), ("x&#x430; quiet shelf", ["script"]),
    ("In 1922 а miller came", ["script"]), ("Он открыл зaвод", ["script"]),
    ("The β-Signal", []), ("the Ω glass", []), ("Новый мост, а дальше сад", []), ("“Quotes” — dashes…", []), ("two  spaces", []), ("Cafe", []), ("Straße Łódź", []), ("&amp; &lt;", []), ("", []), ("THE Β-ARCHIVE", []), ("Книга The New Jar", []),
    ("hօuse by the sea", ["script"]), ("\u13aalpha of the town", ["script"]), ("the p\u0251per boat", ["script"]), ("Henry \u2167", ["form"]), ("Wa\u017f\u017fer", ["form"]), ("он видел cop и дом", ["script"]),
    ("\U0001f469\u200d\U0001f680 flew", []), ("\u2764\ufe0f you", []), ("a \U0001f600 and b\u200bc", ["invisible"]), ("\u0645\u06cc\u200c\u062e\u0648\u0627\u0647\u0645", []), ("x \u6f22\u5b57 \uff34\uff48\uff45 map", ["form"]), ("\u6f22\u5b57\uff08\u6ce8\uff09", []), ("[\u02c8p\u0251\u02d0t\u0259]", []), ("m\u00b2", []),
]


@pytest.mark.parametrize("text,kinds", LOOK)
def test_kinds(text, kinds):
    assert look.kinds_of(text) == kinds


@pytest.mark.parametrize("odd,plain", [("Тhе Оld Mар", "The Old Map"), ("Ｃａｆｅ\u0301", "Café"), ("a\u2009b\u00adc", "a bc"), ("Tomа\u0301s", "Tomás"), ("\U0001f600 <p>soft\u00adhyphen a\u200bb</p>", "\U0001f600 <p>softhyphen ab</p>"), ("\u6f22\u5b57 and more: \uff34\uff48\uff45", "\u6f22\u5b57 and more: The")])
def test_canonical(odd, plain):
    if plain is not None:
        assert look.canonical(odd) == plain


@given(st.text(alphabet="abcеорАВaé\u0301\u200b\u00a0 Ｔﬁβ&;#x2", max_size=30))
@settings(max_examples=300, deadline=None)
def test_canonical_is_fixed(text):
    once = look.canonical(text)
    assert unicodedata.is_normalized("NFC", once) or "&" in once
    if "&" not in text:
        assert look.canonical(once) == once


def test_lookalike_operator(spark):
    m = spark.createDataFrame([("a", "Thе Map", "en", None), ("a", "Thе Map", "en", None), ("b", None, None, None), ("c", "CafÃ©", "en", None), ("d", "", "en", None)], "book_id string, title string, language string, description string")
    c = spark.createDataFrame([(1, "Νick", 9), (2, None, 9)], "creator_id bigint, name string, field int")
    h = spark.createDataFrame([(1, "<p>" + "x" * 100000 + "\u200b</p>"), (2, "<p>plain</p>")], "chapter_id bigint, body_html string")
    w = spark.createDataFrame([], "warning_id bigint, message string")
    assert {tuple(r) for r in look.found(m, c, h, w).collect()} == {("metadata", "a", "title"), ("creators", "1", "name"), ("chapters", "1", "body_html")}
    assert look.found(m.limit(0), c.limit(0), h.limit(0), w).count() == 0
    assert look.canonical_values(m, c, h).where("field = 'title'").count() == 4


def test_wrong_encoding_of_any_language_is_no_lookalike(spark):
    """A title of the language with the least text of eighteen is known as wrongly decoded, so its odd space is no case here."""
    rows = [(f"{lang}{k}", f"The long café of the old harbour and the quiet river number {k}", "", lang) for lang in "aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp qq".split() for k in range(40)]
    rows += [(f"ru{k}", f"берег и старый дом {k}", "", "ru") for k in range(40)] + [("bad", "берег\u00a0и старый дом".encode("cp1251").decode("cp1252"), "", "ru"), ("odd", "The long\u00a0café", "", "aa")]
    none = [spark.createDataFrame([], x) for x in ("creator_id bigint, name string", "chapter_id bigint, body_html string", "warning_id bigint, message string")]
    assert {r.row_key for r in look.found(spark.createDataFrame(rows, TITLES), *none).collect()} == {"odd"}


def test_wrong_encoding_of_titles_in_brackets_is_no_lookalike(spark):
    """A language whose titles are all in brackets is known, so its wrongly decoded title is no case here."""
    rows = [(f"en{k}", f"The long café of the old harbour and the quiet river number {k}", "", "en") for k in range(400)] + [(f"ru{k}", f"[берег и старый дом] {k}", "", "ru") for k in range(40)]
    rows += [("bad", "берег\u00a0и старый дом".encode("cp1251").decode("cp1252"), "", "en"), ("odd", "The long\u00a0café", "", "en")]
    none = [spark.createDataFrame([], x) for x in ("creator_id bigint, name string", "chapter_id bigint, body_html string", "warning_id bigint, message string")]
    assert {r.row_key for r in look.found(spark.createDataFrame(rows, TITLES), *none).collect()} == {"odd"}


MARKED = ["<p>x</p>", "a &amp; b", "**bold** x", "x *em* y", "_under score_ y", "# Head\n\ntext", "[a](http://b)", "![i](j.png)", "`code`", "~~gone~~", "a[^1]\n\n[^1]: note", "([source][1])\n\n[1]: http://x", "> quoted", "- a\n- b", "* a\n\n* b", "[[link|text]]", "{{Infobox|a=b}}", "'''wiki'''", "== Head ==", "[https://x.y label]", "x<ref>y</ref>", "\\textbf{x}", "See~\\cite{k}", "(\\S24)", "$x_{1}^2 = 3$", "\\[ \\frac{a}{b} \\]", "\\begin{itemize}\n\\item a\n\\end{itemize}", "&lt;p&gt;x&lt;/p&gt;", "```\ncode\n```"]
BARE = ["aged 9 < 12 and their R&D-minded parents", "from $3 to $7 a head", "ranked #1 in the poll", "The count, 5 * 3 * 2, was", "wrote “recieved” [sic] here", "the set {salt, rope, tar}", "a - b - c", "* * *", "snake_case_name", "either/or", "it’s 100% ~5", ""]


@pytest.mark.parametrize("text", MARKED)
def test_marked(text):
    assert markup.clean(text, False)[2], text


@pytest.mark.parametrize("text", BARE)
def test_bare(text):
    assert markup.clean(text, False)[2] == []


@given(st.lists(st.sampled_from([*MARKED, "<p>", "</p>", "<b>", "\n", " ", "[", "]", "(", ")", "*", "_", "'", "=", "#", "x", ": y", "; z", "- ", "&ast;", "&#42;", "&amp;", "|", "--", "\\"]), max_size=8).map("".join), st.booleans())
@settings(max_examples=600, deadline=None)
def test_filters_are_wider_than_the_rules(text, page):
    rx = re.compile(markup.PAGE_FILTER if page else markup.DESCRIPTION_FILTER)
    if markup.clean(text, page)[2]:
        assert rx.search(text)


def test_structure():
    out, blocks, seen = markup.clean("# Title\n\n* one\n* two\n\n```\nx = 1\n```\n\n\\[ \\frac{a}{b} \\leq 2 \\]\n\nend", False)
    assert [(k, t) for k, _, t in blocks] == [("heading", "Title"), ("item", "• one"), ("item", "• two"), ("code", "x = 1"), ("formula", "a/b ≤ 2"), ("paragraph", "end")]
    assert "#" not in out and "```" not in out and seen


def test_page():
    page = "<h1>T</h1>\n<p>a &amp; b</p>\n<ol><li>x</li><li>y</li></ol>\n<pre><code>**no** &lt;br&gt;</code></pre>\n"
    out, blocks, seen = markup.clean(page, True)
    assert seen == [] and [k for k, *_ in blocks] == ["heading", "paragraph", "item", "item", "code"] and blocks[3][2] == "2. y"
    assert markup.clean(page + "<p>**left**</p>", True)[2] == ["md strong"]
    assert markup.clean("<p>&lt;b&gt;x&lt;/b&gt;</p>", True)[2] == ["html tag"]


def test_markup_operator(spark):
    m = spark.createDataFrame([(f"m{i}", f'<div class="b"><span>text {i}</span></div>', 1) for i in range(6)] + [("n", None, 1), ("o", "plain", 1)], "book_id string, description string, host int")
    w = spark.createDataFrame([("s:1", "**x**"), ("s:1", "**x**"), ("s:2", "")], "ref string, description string")
    c = spark.createDataFrame([(1, "<p>ok</p>", "b"), (2, "<p>{{t}}</p>", "b"), (3, None, None)], "chapter_id bigint, body_html string, book_id string")
    assert {tuple(r) for r in markup.found(m, w, c).collect()} == {("metadata", f"m{i}") for i in range(6)} | {("works", "s:1"), ("chapters", "2")}
    t = markup.templates(markup.values(m, w, c).where("not page")).collect()
    assert [r.tokens for r in t] == [['<div class="b">', "<span>", "</span>", "</div>"]]
    assert markup.found(m.limit(0), w.limit(0), c.limit(0)).count() == 0
    pages = [(i, f"<h1>T{i}</h1>\n<p>one</p>\n" + "<p>more</p>\n" * i, "z") for i in range(4)]
    out = {r.row_key: r for r in markup.convert(m, w, c.unionByName(spark.createDataFrame(pages, c.schema))).where("tbl = 'chapters' and row_key in ('0', '3')").collect()}
    assert out["3"].slots > 1 and out["0"].residue == []
    first = markup.convert(m, w, c).where("row_key = 'm0'").first()
    assert first.text == "text 0" and first.residue == ["template"]
