"""Problem 6: variant spellings of names typed by people.

Names are parsed into tokens; where each token mostly stands tells surnames
from given names. A symmetric-delete index over the surnames finds those one
edit apart. Names of such surnames meet by keys that all given names that
agree share; these are aligned with initials, nicknames and slips, and each
spelling joins the one person it fits, in rounds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookspark.llm import lookalikes
from bookspark.session import checkpointed

PARSED = "name string, n bigint, typed bigint, filed bigint, org string, comma int, tokens array<string>"

# fixed values: what is no part of a name, what stands between given name and surname, words of organisations
AFFIXES = frozenset("by author authors ed eds edited editor translator trans ill illustrator narrator dr prof professor rev reverend sir dame mr mrs ms miss herr frau mme ltd inc llc gmbh co the jr sr phd md".split())
PARTICLES = frozenset("von van der den de del della di da dos das du la le al el ibn bin ter ten zu zum zur af av".split())
ORG_WORDS = frozenset("university press society institute association collective brothers house publishing company verlag editorial editions books group foundation college academy museum library council committee sons daughters universitat universidad universite gesellschaft".split())
_SHORT = "peggy:margaret meg:margaret maggie:margaret madge:margaret bob:robert rob:robert bobby:robert robbie:robert bert:robert/albert/herbert bill:william will:william billy:william willy:william dick:richard rick:richard rich:richard ted:theodore/edward theo:theodore teddy:theodore/edward jo:josephine/joanna josie:josephine nick:nicholas nicky:nicholas ellie:eleanor/elizabeth nell:eleanor/helen nelly:eleanor/helen nora:eleanor alex:alexander/alexandra sandy:alexander/alexandra xander:alexander vicky:victoria vic:victoria/victor tori:victoria betty:elizabeth liz:elizabeth beth:elizabeth lizzie:elizabeth eliza:elizabeth ben:benjamin benny:benjamin kate:katherine kathy:katherine kay:katherine kitty:katherine katie:katherine fred:frederick freddy:frederick ed:edward/edmund/edwin eddie:edward ned:edward/edmund charlie:charles chuck:charles tony:anthony greg:gregory chris:christopher/christina kit:christopher/katherine becky:rebecca becca:rebecca sue:susannah susie:susannah susan:susannah dot:dorothy dolly:dorothy dottie:dorothy leo:leonard/leopold len:leonard lenny:leonard tilly:matilda mattie:matilda tom:thomas jim:james jack:john joe:joseph mike:michael sam:samuel/samantha dan:daniel dave:david steve:stephen pat:patrick/patricia jenny:jennifer harry:henry/harold hal:henry polly:mary molly:mary"
NICKNAMES = {k: frozenset(v.split("/")) for k, v in (p.split(":") for p in _SHORT.split())}
ORG_SHORT = {"assoc": "association", "assn": "association", "univ": "university", "inst": "institute", "soc": "society", "bros": "brothers", "pub": "publishing", "publ": "publishing", "publishers": "publishing", "publisher": "publishing", "coll": "collective", "pr": "press", "fdn": "foundation", "acad": "academy", "lib": "library", "ed": "editions"}
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "’": "'", "‘": "'"})
_BRACKETS = re.compile(r"\([^)]*\)|\[[^\]]*\]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


#: A surname whose first letter slipped over the space to the particle.
_SPLIT_PARTICLE = re.compile(r"\b([a-z]{2,4})([^\W\d_a-z]) (?=[a-z])")


def fold(text: str) -> str:
    """Consistent script, no accents, lower case."""
    text = unicodedata.normalize("NFKD", lookalikes.canonical(text))
    return "".join(c for c in text if not unicodedata.combining(c)).casefold().translate(_LETTERS)


def parse(name: str) -> tuple[str, int, list[str]]:
    """(kind of organisation or '', number of tokens before a comma, tokens without affixes and particles).

    A token of one letter is an initial; capitals run together beside a mixed
    spelling, or letters with dots between, are initials one by one.
    """
    shown = unicodedata.normalize("NFC", lookalikes.canonical(name))
    shown = _SPLIT_PARTICLE.sub(lambda m: f"{m[1]} {m[2]}" if m[1] in PARTICLES else m[0], shown)
    shown = _BRACKETS.sub(lambda m: " " if all(w in AFFIXES for w in _WORD.findall(fold(m[0]))) else m[0], shown)
    mixed = any(len(w) > 2 and not w.isupper() for w in _WORD.findall(shown))
    capitals = any(w[0].isupper() for w in _WORD.findall(shown))
    parts = [_WORD.findall(p) for p in shown.split(",")]
    parts = [p for p in ([w for w in p if fold(w) not in AFFIXES or (len(w) == 2 and w.isupper() and mixed)] for p in parts) if p]
    out: list[list[str]] = []
    org = []
    for p in parts:
        here = []
        for w in p:
            f = fold(w).replace("'", "")
            if ORG_SHORT.get(f, f) in ORG_WORDS:
                org.append(ORG_SHORT.get(f, f))
            elif f in PARTICLES and len(p) + len(parts) > 2:
                continue
            elif capitals and w.islower() and len(w) <= 4 and any(slip(f, x) for x in PARTICLES):
                continue  # a particle with a slip
            elif len(w) <= 3 and w.isupper() and mixed and len(w) > 1:
                here += list(f)
            else:
                here.append(f)
        if here:
            out.append(here)
    tokens = [t for p in out for t in p]
    return " ".join(sorted(org)), len(out[0]) if len(out) == 2 and not org else 0, tokens


def slip(a: str, b: str) -> bool:
    """Equal but for one letter added, lost or changed, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) == len(y) and x[:2] == y[1::-1] and x[2:] == y[2:])


#: A letter with two dots typed without them.
_DIGRAPH = re.compile("([aou])e")


def formal(name: str) -> frozenset[str]:
    return NICKNAMES.get(name, frozenset()) | {name}


def given_match(a: str, b: str, known: dict[str, int] | None = None) -> float:
    """How well two given names agree: 1 equal, less for nickname, slip and initial, 0 not at all."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.6 if {x[0] for x in formal(a)} & {x[0] for x in formal(b)} else 0.0
    if formal(a) & formal(b) or _DIGRAPH.sub(r"\1", a) == _DIGRAPH.sub(r"\1", b):
        return 0.95
    if known:
        lo, hi = sorted((known.get(a, 0), known.get(b, 0)))
        if lo >= COMMON and lo * 8 > hi:
            return 0.0
        if min(len(a), len(b)) == 3 and lo * 8 <= hi and slip(a, b):
            return 0.8
    if min(len(a), len(b)) >= 4 and slip(a, b):
        return 0.8
    return 0.7 if any(len(x) >= 4 and len(y) >= 4 and slip(x, y) for x in formal(a) for y in formal(b)) else 0.0


#: Spellings from which a name is established, so that another one letter away is another name.
COMMON = 4


def assignment(score: list[list[float]]) -> list[int]:
    """The column of each row in the assignment of all rows with the greatest sum; rows are at most as many as columns."""
    n, m = len(score), len(score[0])
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while row_of[j]:
            used[j], r, delta, to = True, row_of[j], float("inf"), 0
            for k in range(1, m + 1):
                if not used[k]:
                    cost = -score[r - 1][k - 1] - u[r] - v[k]
                    if cost < least[k]:
                        least[k], way[k] = cost, j
                    if least[k] < delta:
                        delta, to = least[k], k
            for k in range(m + 1):
                if used[k]:
                    u[row_of[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = to
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    out = [0] * n
    for k in range(1, m + 1):
        if row_of[k]:
            out[row_of[k] - 1] = k - 1
    return out


#: What an assignment out of order is worth of one in order.
REORDERED = 0.85


def align(a: tuple[str, ...], b: tuple[str, ...], known: dict[str, int] | None = None) -> float:
    """Best assignment of the shorter list of given names to the longer; 0 if any stays unmatched.

    In order the first names agree, as others may be left out but not the
    first. Out of order it counts less, needs two full names that agree, and
    the first of the longer list must be taken; where neither list has any
    names, the surname alone agrees weakly.
    """
    if not a or not b:
        return 0.5 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    match = [[given_match(s, x, known) for x in long] for s in short]
    none = float("-inf")
    best = [match[0][0] or none] + [none] * (len(long) - 1)
    for row in match[1:]:
        before, top = best, none
        best = []
        for k, score in enumerate(row):
            best.append(top + score if score else none)
            top = max(top, before[k])
    ordered = max(best)
    at = assignment([[x or -float(2 * len(short)) for x in row] for row in match]) if len(short) > 1 else [0]
    got = [row[k] for row, k in zip(match, at, strict=True)]
    full = any(len(s) > 1 and len(long[k]) > 1 for s, k in zip(short, at, strict=True))
    swapped = REORDERED * sum(got) if all(got) and full and 0 in at and len(short) > 1 else 0.0
    return max(ordered, swapped, 0.0) / len(short)



def spellings(creators: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct names with their counts as typed (in either name column) and as filed (in file_as); blanks and nulls left out."""

    def one(names: DataFrame, typed: int) -> DataFrame:
        return names.select("name", F.lit(typed).alias("typed"), F.lit(1 - typed).alias("filed"))

    every = one(creators.select("name"), 1).unionByName(one(candidates.select(F.explode("author_name").alias("name")), 1)).unionByName(one(creators.select(F.col("file_as").alias("name")), 0))
    return every.where("name is not null and trim(name) <> ''").groupBy("name").agg(F.count("*").alias("n"), F.sum("typed").alias("typed"), F.sum("filed").alias("filed"))


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(name, n, typed, filed, *parse(name)) for name, n, typed, filed in pdf[["name", "n", "typed", "filed"]].itertuples(index=False)]
        yield pd.DataFrame(rows, columns=["name", "n", "typed", "filed", "org", "comma", "tokens"])


def roles(parsed: DataFrame) -> DataFrame:
    """Per token how often it stands as a surname and as a given name; forms with a comma tell most. Filed forms without one tell nothing."""
    typed = parsed.where("typed > 0").select(F.col("typed").alias("n"), "org", "comma", "tokens")
    every = typed.unionByName(parsed.where("filed > 0 and name like '%,%'").select(F.col("filed").alias("n"), "org", "comma", "tokens"))
    at = every.where("org = '' and size(tokens) > 1").select("n", "comma", F.size("tokens").alias("k"), F.posexplode("tokens").alias("i", "token")).where("length(token) > 1")
    weight = F.when(F.col("comma") > 0, 3).otherwise(1) * F.col("n")
    last = F.when(F.col("comma") > 0, F.col("i") < F.col("comma")).otherwise(F.col("i") == F.col("k") - 1)
    return at.groupBy("token").agg(F.sum(F.when(last, weight).otherwise(0)).alias("as_surname"), F.sum(F.when(last, 0).otherwise(weight)).alias("as_given"), F.sum(F.when(last, 0).otherwise(1)).alias("given_spellings"))


def split_surname(parsed: DataFrame, role: DataFrame) -> DataFrame:
    """name, n, org, surname, given: the token that is most of a surname, and the others in order."""
    tok = parsed.where("size(tokens) > 0").select("name", "n", "typed", "org", "comma", F.posexplode("tokens").alias("i", "token"))
    scored = tok.join(role, "token", "left").withColumn("share", F.when(F.length("token") == 1, F.lit(-1.0)).when((F.col("comma") > 0) & (F.col("i") < F.col("comma")), F.lit(2.0)).otherwise(F.coalesce((F.col("as_surname") + 0.5) / (F.col("as_surname") + F.col("as_given") + 1), F.lit(0.5))))
    by_name = scored.groupBy("name", "n", "typed", "org").agg(F.array_sort(F.collect_list(F.struct("i", "token", "share"))).alias("t"), F.max(F.struct("share", "i")).alias("top"))
    return by_name.select("name", "n", "typed", "org", F.expr("element_at(filter(t, x -> x.i = top.i), 1).token").alias("surname"), F.expr("transform(filter(t, x -> x.i <> top.i), x -> x.token)").alias("given"))


def surname_frequency(split: DataFrame) -> DataFrame:
    """surname, frequency (in typed spellings; one where it is only filed)."""
    return split.groupBy("surname").agg(F.greatest(F.count_if(F.col("typed") > 0), F.lit(1)).alias("frequency"))


def surname_pairs(own: DataFrame) -> DataFrame:
    """(surname, other, strict) both ways: each surname with itself and every one an edit away that may be a slip of it.

    The symmetric-delete index holds each surname with every one of its letters
    left out; two that share an entry are compared. Two established surnames
    of like frequency are two surnames; where one has less than five letters
    and the other is not eight times as frequent, the pair is ``strict``: it
    holds only for the same given names.
    """
    long = own.where("length(surname) >= 3")
    deletes = F.array_distinct(F.concat(F.array("surname"), F.expr("transform(sequence(1, length(surname)), i -> concat(left(surname, i - 1), substring(surname, i + 1)))")))
    index = long.select("surname", "frequency", F.explode(deletes).alias("entry"))
    a, b = index.alias("a"), index.alias("b")
    pairs = a.join(b, F.col("a.entry") == F.col("b.entry")).where(F.col("a.surname") != F.col("b.surname")).select(F.col("a.surname").alias("surname"), F.col("b.surname").alias("other"), F.least("a.frequency", "b.frequency").alias("lo"), F.greatest("a.frequency", "b.frequency").alias("hi")).distinct()
    sure = F.least(F.length("surname"), F.length("other")) >= 5
    strict = ~(sure | (F.col("lo") * 8 <= F.col("hi")))
    slips = pairs.where(F.when(strict, F.col("lo") < COMMON).otherwise((F.col("lo") < COMMON) | (F.col("lo") * 2 <= F.col("hi"))))
    near = slips.withColumn("strict", strict).mapInPandas(_slips, "surname string, other string, strict boolean")
    return near.unionByName(own.select("surname", F.col("surname").alias("other"), F.lit(False).alias("strict")))


def _slips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.loc[[slip(a, b) for a, b in pdf[["surname", "other"]].itertuples(index=False)], ["surname", "other", "strict"]]


def given_keys(given: tuple[str, ...]) -> list[tuple[str, bool]]:
    """(key, whether it is of an initial): any two lists that ``align`` share a key.

    Two full names that agree share a formal form or an entry of its
    symmetric-delete neighbourhood. Without such a pair the first names agree
    by an initial, so one of the two keys is of an initial.
    """
    if not given:
        return [("", True)]
    out = {("i" + x[0], len(given[0]) == 1) for x in formal(given[0])}
    for g in given:
        for x in formal(g) if len(g) > 1 else ():
            out |= {("w" + x, True), ("w" + _DIGRAPH.sub(r"\1", x), True)}
            if len(x) > 2:
                out |= {("w" + x[:k] + x[k + 1:], True) for k in range(len(x))}
    return sorted(out)


def agree(org: str, a: tuple[str, ...], a_n: list[int], b: tuple[str, ...], b_n: list[int]) -> float:
    """Agreement of the given names of two signatures, or of two organisations without any."""
    if org and not a and not b:
        return 1.0
    return align(a, b, dict(zip(a, a_n, strict=True)) | dict(zip(b, b_n, strict=True)))


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(sig, k, one) for sig, given in pdf[["sig", "given"]].itertuples(index=False) for k, one in given_keys(tuple(given))]
        yield pd.DataFrame(rows, columns=["sig", "key", "one"])


def _agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        score = [agree(o, tuple(a), list(an), tuple(b), list(bn)) for o, a, an, b, bn in pdf[["org", "given", "given_n", "f_given", "f_given_n"]].itertuples(index=False)]
        yield pdf.assign(score=pd.Series(score, index=pdf.index, dtype="float64"))


def scored(pairs: DataFrame) -> DataFrame:
    """The pairs of org, given, given_n with f_given, f_given_n, and how well they agree."""
    return pairs.mapInPandas(_agree, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", score double")


def signatures(split: DataFrame, counted: DataFrame, own: DataFrame) -> DataFrame:
    """Each (organisation, surname, given names) once, with its rank: full forms first, then the frequent ones."""
    g = split.join(counted, "name").groupBy("org", "surname", "given").agg(F.sum("n").alias("n"), F.first("given_n").alias("given_n"))
    full = F.size(F.filter("given", lambda x: F.length(x) > 1))
    return g.join(own, "surname").withColumn("sig", signature()).withColumn("rank", F.struct((-full).alias("full"), (-F.size("given")).alias("k"), (-F.col("n")).alias("n"), F.col("sig")))


def signature() -> Column:
    return F.concat_ws("|", "org", "surname", F.concat_ws(" ", "given"))


def rivals(sigs: DataFrame, related: DataFrame) -> DataFrame:
    """(u, v) of every two signatures that may be one person, v of the earlier rank.

    A join on surname and key of given names, so no group of a surname is
    ever held in one place.
    """
    keys = checkpointed(sigs.select("sig", "given").mapInPandas(_keys, "sig string, key string, one boolean"))
    side = sigs.select("sig", "org", "surname").join(keys, "sig")
    a = side.select("org", "surname", "key", F.col("sig").alias("u"), F.col("one").alias("u_one"))
    b = side.join(related, "surname").select("org", F.col("other").alias("surname"), "key", F.col("sig").alias("v"), F.col("one").alias("v_one"), "strict")
    near = a.join(b, ["org", "surname", "key"]).where("(u_one or v_one) and u <> v").groupBy("u", "v").agg(F.min("strict").alias("strict"))
    ua = sigs.select(F.col("sig").alias("u"), "org", "given", "given_n", F.col("rank").alias("u_rank"))
    vb = sigs.select(F.col("sig").alias("v"), F.col("given").alias("f_given"), F.col("given_n").alias("f_given_n"), F.col("rank").alias("v_rank"))
    both = near.join(ua, "u").join(vb, "v").where("v_rank < u_rank and (not strict or given = f_given and exists(given, g -> length(g) >= 4))").drop("u_rank", "v_rank", "strict")
    return scored(both).where("score > 0").select("u", "v")


def persons(sigs: DataFrame, edges: DataFrame) -> DataFrame:
    """sig, person: each signature in its rank joins the one person it fits, or makes a new one.

    Full forms come first and make the persons, so that an initial or a left
    out name never joins two of them; a form that fits several goes to the one
    that is twice as frequent as the next, else it stays alone. What a
    signature does depends only on its earlier rivals, so in each round all
    of those decide whose rivals have.
    """
    founder = [F.col("sig").alias("person"), F.col("given").alias("f_given"), F.col("given_n").alias("f_given_n")]
    known = ["surname", "frequency", "n"]
    # an edge carries what its signature needs to decide, so that a round is one join; plans and broadcasts of many small ones fill the driver
    own = [*[F.col(c).alias(f"u_{c}") for c in known], "org", "given", "given_n"]
    edges = checkpointed(edges.join(sigs.select(F.col("sig").alias("u"), *own), "u"))
    held = edges.columns
    facts = [c for c in held if c not in ("u", "v")]
    state = checkpointed(sigs.join(edges.select(F.col("u").alias("sig")).distinct(), "sig", "left_anti").select("sig", *known, *founder))
    order = Window.partitionBy("u").orderBy(F.desc("fit"), F.desc("good"), F.desc("exact"), F.desc("pn"), F.desc("person"))
    # each round adds what it decided; the rounds before are read as they were written
    while not edges.isEmpty():
        waits = F.max(F.col("person").isNull()).over(Window.partitionBy("u"))
        look = checkpointed(edges.join(state.withColumnRenamed("sig", "v"), "v", "left").withColumn("waits", waits))
        seen = look.where("not waits").groupBy("u", "person").agg(F.sum("n").alias("pn"), F.max(F.struct("frequency", "surname")).alias("top"), *[F.first(c).alias(c) for c in ("f_given", "f_given_n", *facts)])
        fits = scored(seen).withColumns({"fit": F.col("score") > 0, "good": F.col("score") >= 0.9, "exact": F.col("top.surname") == F.col("u_surname")})
        two = fits.withColumn("at", F.row_number().over(order)).where("at <= 2")
        best = [F.max(F.when((F.col("at") == k) & F.col("fit"), F.struct("good", "exact", "pn", "person", "f_given", "f_given_n"))).alias(f"b{k}") for k in (1, 2)]
        pick = two.groupBy("u").agg(*best, *[F.first(c).alias(c) for c in facts])
        joins = F.col("b1").isNotNull() & (F.col("b2").isNull() | (F.col("b1.good") != F.col("b2.good")) | (F.col("b1.exact") != F.col("b2.exact")) | (F.col("b1.pn") >= 2 * F.col("b2.pn")))
        place = [F.when(joins, F.col(f"b1.{to}")).otherwise(F.col(own)).alias(to) for to, own in (("person", "u"), ("f_given", "given"), ("f_given_n", "given_n"))]
        new = checkpointed(pick.select(F.col("u").alias("sig"), *[F.col(f"u_{c}").alias(c) for c in known], *place))
        edges = look.where("waits").select(held)
        state = state.unionByName(new)
    return state.select("sig", "person")


def link(creators: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every distinct spelling, file_as included, with its person or organisation.

    Defined results: nulls and blanks give no row; a name without letters
    stays alone; ties go by the order of the alphabet; the result does not
    depend on the order of rows.
    """
    return _linked(creators, candidates).select("name", "n", "person")


def _linked(creators: DataFrame, candidates: DataFrame) -> DataFrame:
    """As ``link``, with the count as typed."""
    parsed = checkpointed(spellings(creators, candidates).mapInPandas(_parse, PARSED))
    role = roles(parsed)
    split = checkpointed(split_surname(parsed, role))
    own = surname_frequency(split)
    given_n = role.select(F.col("token").alias("g"), F.col("given_spellings"))
    counted = (
        split.select("name", F.posexplode_outer("given").alias("i", "g")).join(given_n, "g", "left")
        .groupBy("name").agg(F.expr("transform(array_sort(collect_list(struct(i, g, coalesce(given_spellings, 0L) as c))), x -> x.c)").alias("given_n"))
    )
    counted = counted.join(split.select("name", F.size("given").alias("k")), "name").select("name", F.expr("slice(given_n, 1, k)").alias("given_n"))
    sigs = checkpointed(signatures(split, counted, own))
    of = persons(sigs, rivals(sigs, surname_pairs(own)))
    alone = parsed.where("size(tokens) = 0").select("name", "n", "typed", F.concat(F.lit("::"), "name").alias("person"))
    return split.withColumn("sig", signature()).join(of, "sig").select("name", "n", "typed", "person").unionByName(alone)


def found(creators: DataFrame, candidates: DataFrame) -> DataFrame:
    """All pairs of spellings of one person in the name columns, which is the form this result is defined in."""
    linked = checkpointed(_linked(creators, candidates).where("typed > 0").select("name", "person"))
    a, b = linked.select("person", F.col("name").alias("name_a")), linked.select("person", F.col("name").alias("name_b"))
    return a.join(b, "person").where("name_a < name_b").select("name_a", "name_b").distinct()


def coverage(creators: DataFrame, candidates: DataFrame) -> DataFrame:
    """(origin, n_spellings, n_linked): spellings by where they stand, and those that come out with exactly one person; none is lost."""
    linked = _linked(creators, candidates)
    one = linked.groupBy("name").agg(F.count_distinct("person").alias("persons"), F.max("typed").alias("typed"))
    return one.groupBy(F.when(F.col("typed") > 0, "typed").otherwise("filed").alias("origin")).agg(F.count("*").alias("n_spellings"), F.count_if(F.col("persons") == 1).alias("n_linked"))
