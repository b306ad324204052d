"""Names and record matching: the indexes against brute force, and small whole cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bookspark.llm import matching as mm
from bookspark.llm import names


def osa(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@given(st.text(alphabet="abc", max_size=7), st.text(alphabet="abc", max_size=7))
@settings(max_examples=400, deadline=None)
def test_slip_and_near(a, b):
    assert names.slip(a, b) == (osa(a, b) <= 1)
    assert mm.near(a, b) == (osa(a, b) <= 2)


@given(st.sets(st.integers(0, mm.BITS - 1), max_size=40), st.lists(st.integers(0, mm.BITS - 1), max_size=mm.RADIUS, unique=True))
@settings(max_examples=300, deadline=None)
def test_keys_are_exact(bits, flips):
    """Any two vectors within the radius share a key."""
    other = bits ^ set(flips)
    assert set(mm.keys_of(sorted(bits))) & set(mm.keys_of(sorted(other)))


TITLES = [("The Painted Tent of Hesha (Volume 2)", (["painted", "tent", "of", "hesha"], 2)), ("Granary of Dize, The", (["granary", "of", "dize"], None)), ("X’s Notebook - 1", (["x", "s", "notebook"], 1)), ("27 Lakes: A Novel", (["27", "lakes"], None)), ("Серый мост: очерк 563 II", (["серыи", "мост", "очерк", "563"], 2)), ("Tall Cloak, Vol. 3 / Letters, 1899", (["tall", "cloak"], 3)), (None, ([], None)), ("", ([], None))]


@pytest.mark.parametrize("title,want", TITLES)
def test_titles(title, want):
    assert mm.title_parts(title) == want


def test_isbn():
    assert mm.isbn_core("ISBN 978-67-0000-398-5") == mm.isbn_core("67-0000-398-X") == "670000398" and mm.isbn_core("shop-123") is None


GROUPS = [["Ann Mary Fosterling", "Fosterling, Ann", "A. M. Fosterling", "by Ann Fosterling", "ANN FOSTERLING", "Ann Fosterlnig", "Fosterling AM", "Аnn Fosterling"], ["Robert Fosterling", "Bob Fosterling", "Fosterling,Rob"], ["Zoë van der Brugmann", "van der Brugmann, Zoe", "Dr. Zoë van der Brugmann"], ["Hillcrest Press", "Press Hillcrest", "The Hillcrest Press (ed.)", "HILLCREST PRESS", "Hillcrest Press Ltd"], ["Hillcrest University"]]


def frames(spark):
    from itertools import chain

    rows = [(i, n, None, 1) for i, n in enumerate(chain(*GROUPS))] + [(90, None, None, 1), (91, "  ", None, 1), (92, "***", None, 1)] + [(80 + k, f"{g} Marlowe", None, 1) for k, g in enumerate(["Ann", "Robert", "Zoë"])] + [(70 + k, GROUPS[0][0], "Fosterling, Ann Mary", 1) for k in range(3)]
    c = spark.createDataFrame(rows, "creator_id bigint, name string, file_as string, person int")
    d = spark.createDataFrame([("r", ["Ann Mary Fosterling", None, ""]), ("q", None), ("p", [])], "ref string, author_name array<string>")
    return c, d


def test_people(spark):
    c, d = frames(spark)
    of = {r.name: r.person for r in names.link(c, d).collect()}
    for g in GROUPS:
        assert len({of[n] for n in g}) == 1, {n: of[n] for n in g}
    assert len({of[g[0]] for g in GROUPS}) == len(GROUPS)
    pairs = {tuple(r) for r in names.found(c, d).collect()}
    assert len(pairs) == sum(len(g) * (len(g) - 1) // 2 for g in GROUPS) and all(a < b for a, b in pairs)
    assert names.found(c.limit(0), d.limit(0)).count() == 0


META = "book_id string, title string, language string, authors array<struct<name:string,file_as:string,role:string>>, identifiers array<struct<value:string,scheme:string>>, date string, publisher string, series struct<name:string,index:string>, description string, ref int"
CAND = "ref string, title string, author_name array<string>, isbn array<string>, first_publish_year int, publisher array<string>, score float, book_id int"


def test_match(spark):
    who = [("Ann Fosterling", None, None)]
    m = spark.createDataFrame(
        [("b1", "The Painted Tents of Heshafle", "en", who, [("9786700003985", None)], "1955-02-01", "Gupa Press", None, None, 1), ("b1", "The Painted Tents of Heshafle", "en", who, [("9786700003985", None)], "1955-02-01", "Gupa Press", None, None, 1),
         ("b2", "painted tents of heshafel", "en", who, None, "1956", None, None, None, 1), ("b3", "Silver Harbour (Volume 1)", "en", who, [], None, None, None, None, 1), ("b4", "Silver Harbour (Volume 2)", "en", who, [], None, None, None, None, 1), ("b5", None, None, None, None, None, None, None, None, 1), ("b6", "", None, [], [], "", "", None, None, 1)], META)
    c = spark.createDataFrame(
        [("r1", "Painted Tents of Heshafle, The: A Novel", ["A. Fosterling"], None, 1955, None, None, 1), ("r1", "Painted Tents of Heshafle, The: A Novel", ["A. Fosterling"], None, 1955, None, None, 1), ("r2", "The Painted Tents of Heshafle", ["Otto Brandt"], [], 1999, ["Other"], None, 1), ("r3", "Silver Harbour, Book 2", ["Fosterling, Ann"], [], None, [], None, 1), ("r4", None, None, None, None, None, None, 1)], CAND)
    assert {tuple(r) for r in mm.found(m, c).collect()} == {("b1", "r1"), ("b2", "r1"), ("b4", "r3")}
    assert mm.match(m, c).where("confidence < 0 or confidence > 1").count() == 0
    assert mm.found(m.limit(0), c).count() == 0 and mm.found(m, c.limit(0)).count() == 0


def test_wrong_encoding_of_any_language_matches(spark):
    """A wrongly decoded title in the language with the least text of eighteen finds its record."""
    who = [("Ann Fosterling", None, None)]
    m = [(f"{lang}{k}", f"The long café of the old harbour and the quiet river {lang}{k}", lang, None, None, None, None, None, None, 1) for lang in "aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp qq".split() for k in range(40)]
    m += [(f"ru{k}", f"берег и старый дом {k}", "ru", None, None, None, None, None, None, 1) for k in range(40)] + [("bad", "берег и старый дом".encode("cp1251").decode("cp1252"), "ru", who, None, "1955", None, None, None, 1)]
    c = [("r", "берег и старый дом", ["Ann Fosterling"], None, 1955, None, None, 1)]
    assert ("bad", "r") in {tuple(r) for r in mm.found(spark.createDataFrame(m, META), spark.createDataFrame(c, CAND)).collect()}


def test_wrong_encoding_of_a_language_of_records_matches(spark):
    """A wrongly decoded title finds its record where only the records have its language."""
    m = [(f"en{k}", f"The long café of the old harbour and the quiet river {k}", "en", None, None, None, None, None, None, 1) for k in range(400)] + [("bad", "берег и старый дом".encode("cp1251").decode("cp1252"), "en", [("Ann Fosterling", None, None)], None, "1955", None, None, None, 1)]
    c = [("r", "берег и старый дом", ["Ann Fosterling"], None, 1955, None, None, 1)] + [(f"r{k}", f"берег и старый дом {k}", None, None, None, None, None, 1) for k in range(40)]
    assert ("bad", "r") in {tuple(r) for r in mm.found(spark.createDataFrame(m, META), spark.createDataFrame(c, CAND)).collect()}


def test_every_compared_pair_counts(spark, monkeypatch):
    """Pairs that only a changed digit of an ISBN brought together are counted in an estimate, too."""
    m = [("a", "Silver Harbour", "en", None, [("9780306406158", None)], None, None, None, None, 1), ("b", "The Painted Tents of Heshafle", "en", None, None, None, None, None, None, 1)]
    c = [("r", "Quiet Granary", None, ["9780306406257"], None, None, None, 1), ("q", "Painted Tents of Heshafle", None, None, None, None, None, 1)]
    counted, estimate = [], mm.estimate
    monkeypatch.setattr(mm, "estimate", lambda patterns: (counted.extend(n for _, n in patterns), estimate(patterns))[1])
    got = {(r.book_id, r.ref) for r in mm.match(spark.createDataFrame(m, META), spark.createDataFrame(c, CAND)).collect()}
    assert got == {("a", "r"), ("b", "q")} and sum(counted) == 2


def test_close_titles_against_brute_force(spark):
    rng = random.Random(6)
    words = ["harbour", "granary", "lantern", "thimbles", "corridor", "sparrow", "candle", "orchards", "meadow", "whistle"]
    titles = [[rng.choice(words), rng.choice(words)] for _ in range(60)]
    typed = []
    for t in titles:
        w = list(t[0])
        w[rng.randrange(len(w))] = "x"
        typed.append(["".join(w), t[1]])
    left = spark.createDataFrame([(str(i), t) for i, t in enumerate(titles)], "id string, tokens array<string>")
    right = spark.createDataFrame([(str(i), t) for i, t in enumerate(typed)], "id string, tokens array<string>")
    got = {(tuple(r.l_tokens), tuple(r.r_tokens)) for r in mm.close_titles(left, right, frozenset()).collect()}
    bits = {tuple(t): set(mm.vector(t, frozenset())) for t in titles + typed}
    want = {(tuple(a), tuple(b)) for a in titles for b in typed if len(bits[tuple(a)] ^ bits[tuple(b)]) <= min(mm.RADIUS, max(6, (len(bits[tuple(a)]) + len(bits[tuple(b)])) // 4))}
    assert got == want and {(tuple(a), tuple(b)) for a, b in zip(titles, typed, strict=True)} <= want


def test_a_round_is_one_join(spark, monkeypatch):
    """Deciding takes no more joins than checkpoints, as the broadcasts of many small joins fill the driver."""
    c, d = frames(spark)
    count, join, checkpointed, persons = {"joins": 0, "checkpoints": 0}, type(c).join, names.checkpointed, names.persons

    def counted(kind, f):
        return lambda *args, **kw: (count.update({kind: count[kind] + 1}), f(*args, **kw))[1]

    def watched(sigs, edges):
        with monkeypatch.context() as m:
            m.setattr(type(c), "join", counted("joins", join))
            m.setattr(names, "checkpointed", counted("checkpoints", checkpointed))
            return persons(sigs, edges)

    monkeypatch.setattr(names, "persons", watched)
    of = {r.name: r.person for r in names.link(c, d).collect()}
    assert all(len({of[n] for n in g}) == 1 for g in GROUPS) and 0 < count["joins"] <= count["checkpoints"]


def test_large_surname_links_like_a_small_one(spark):
    """Nicknames and slips with another initial link in a surname of more than 20,000 spellings."""
    rng = random.Random(1)
    others = {"".join(rng.choice("bcdfghjklmnpqrstvwxz" if k % 2 else "aeiou") for k in range(9)).title() for _ in range(21_000)}
    same = [("Bob Marlowe", "Robert Marlowe"), ("Peggy Anne Marlowe", "Margaret Anne Marlowe"), ("Frederick Marlowe", "Rfederick Marlowe")]
    rows = [(n, None) for n in [f"{g} Marlowe" for g in sorted(others)] + [x for p in same for x in p]]
    of = {r.name: r.person for r in names.link(spark.createDataFrame(rows, "name string, file_as string"), spark.createDataFrame([], "author_name array<string>")).where("name rlike '^(Bob|Robert|Peggy|Margaret|Rfederick|Frederick) '").collect()}
    assert len(of) == 6 and all(of[a] == of[b] for a, b in same)
    assert of["Bob Marlowe"] != of["Peggy Anne Marlowe"]


def test_surname_with_two_neighbours(spark):
    """A surname keeps its own slips where a more frequent one is an edit away from it."""
    rows = [(n, None) for n in ["F. Dregrastatarn", "Frederick Dregrastatran", "Anna Dregrsatatran", "Otto Dregrsatatran", "Hugo Dregrsatatran", "Paul Dregrsatatran", "Wilma Dregrastatran"]]
    of = {r.name: r.person for r in names.link(spark.createDataFrame(rows, "name string, file_as string"), spark.createDataFrame([], "author_name array<string>")).collect()}
    assert of["F. Dregrastatarn"] == of["Frederick Dregrastatran"]


def test_sort_forms_are_linked(spark):
    c, d = frames(spark)
    c = c.unionByName(spark.createDataFrame([(60, "R. Fosterling", "FOSTERLING, ROBERT", 1), (61, None, "Fosterlnig, Ann", 1)], c.schema))
    of = {r.name: r.person for r in names.link(c, d).collect()}
    assert of["FOSTERLING, ROBERT"] == of["Robert Fosterling"] and of["Fosterlnig, Ann"] == of["by Ann Fosterling"]
    assert "FOSTERLING, ROBERT" not in {n for p in names.found(c, d).collect() for n in p}


def test_title_of_very_many_rows(spark):
    """An author typed without accents confirms a title that more than 100,000 pairs of rows share."""
    m = [(f"b{k}", "Silver Harbour", "en", None, None, None, None, None, None, 1) for k in range(340)] + [("b", "Silver Harbour", "en", [("José García", None, None)], None, None, None, None, None, 1)]
    c = [(f"r{k}", "Silver Harbour", None, None, None, None, None, 1) for k in range(340)] + [("r", "Silver Harbour", ["Jose Garcia"], None, None, None, None, 1)]
    got = {tuple(r) for r in mm.found(spark.createDataFrame(m, META), spark.createDataFrame(c, CAND)).where("book_id = 'b' and ref = 'r'").collect()}
    assert got == {("b", "r")}


def test_given_names_out_of_order():
    split = lambda x: tuple(x.split())
    assert names.align(split("anna maria"), split("maria anna")) > 0 and names.align(split("a j john"), split("a john james")) > 0
    assert names.align(split("anna maria"), split("anna maria")) > names.align(split("anna maria"), split("maria anna"))
    assert not names.align(split("m a"), split("anna maria")) and not names.align(split("f"), split("john f"))


def test_weights_are_estimated():
    """From the counts of patterns alone the estimate finds which levels tell pairs of one work, and calibrates them."""
    rng = random.Random(2)
    from collections import Counter
    from math import exp

    m = ((0.9, 0.08, 0.01, 0.005, 0.005), (0.1, 0.8, 0.05, 0.04, 0.01), (1, 0, 0, 0), (0.7, 0.2, 0.09, 0.01), (0.3, 0.6, 0.05, 0.03, 0.01, 0.01), (0.5, 0.45, 0.05))
    u = ((0.3, 0.1, 0.1, 0.2, 0.3), (0.1, 0.2, 0.05, 0.05, 0.6), (1, 0, 0, 0), (0.7, 0.02, 0.02, 0.26), (0.3, 0.1, 0.1, 0.1, 0.1, 0.3), (0.5, 0.05, 0.45))
    pairs = [(same, tuple(rng.choices(range(len(d)), d)[0] for d in (m if same else u))) for same in [rng.random() < 0.3 for _ in range(20_000)]]
    odds, weights = mm.estimate([(list(p), n) for p, n in Counter(p for _, p in pairs).items()])
    bins = Counter(), Counter()
    for same, p in pairs:
        c = round(1 / (1 + exp(-odds - sum(w[k] for w, k in zip(weights, p, strict=True)))), 1)
        bins[0][c] += 1
        bins[1][c] += same
    assert all(abs(bins[1][c] / n - c) < 0.12 for c, n in bins[0].items() if n > 300)
    assert mm.estimate([])[1][2][mm.OTHER_VOLUME] < -20


def test_close_isbns_against_brute_force(spark):
    rng = random.Random(3)
    cores = ["".join(rng.choice("0123456789") for _ in range(9)) for _ in range(40)]
    typed = [c[:k] + str((int(c[k]) + 3) % 10) + c[k + 1:] for c in cores for k in [rng.randrange(9)]]
    left = spark.createDataFrame([(f"b{i}", [c], []) for i, c in enumerate(cores)], "id string, isbns array<string>, doubtful array<string>")
    right = spark.createDataFrame([(f"r{i}", [c], [c]) for i, c in enumerate(typed)] + [("same", [cores[0]], []), ("none", [], []), ("null", None, None)], "id string, isbns array<string>, doubtful array<string>")
    got = {(r.book_id, r.ref) for r in mm.close_isbns(left, right).collect()}
    want = {(f"b{i}", f"r{j}") for i, a in enumerate(cores) for j, b in enumerate(typed) if sum(x != y for x, y in zip(a, b, strict=True)) <= 1} | {("b0", "same")}
    assert got == want and len(want) == 41
    assert mm.isbn_holds("978-0-306-40615-7") and mm.isbn_holds("0-306-40615-2") and not mm.isbn_holds("0-306-40615-3") and not mm.isbn_holds("x")


def test_slips_of_rare_and_short_surnames(spark):
    """Chains of slips and slips in short surnames link where the given names are the same; other given names don't."""
    rows = ["Wilhelmina Andersen", "Wilhelmina Andersenn", "Anna Anderson", "Otto Anderson", "Hugo Anderson", "Paul Anderson", "Karl Anderson", "Barbara Wells", "Barbara Wlls", "Theodora Reed", "Theodora Redd", "Theodora Rreed", "Simon Reed", "Hanna Redd"]
    of = {r.name: r.person for r in names.link(spark.createDataFrame([(n, None) for n in rows], "name string, file_as string"), spark.createDataFrame([], "author_name array<string>")).collect()}
    assert of["Wilhelmina Andersen"] == of["Wilhelmina Andersenn"] != of["Anna Anderson"]
    assert of["Barbara Wells"] == of["Barbara Wlls"] and of["Theodora Reed"] == of["Theodora Redd"] == of["Theodora Rreed"]
    assert of["Simon Reed"] != of["Hanna Redd"] and of["Simon Reed"] != of["Theodora Reed"]
