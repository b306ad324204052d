"""Problem 9: texts that were cut before their own end, in pure SQL.

Word trigrams are counted inside texts and at their ends. A final trigram that
is frequent inside but almost never terminal marks a cut; so does one that
goes on inside with a longer last word. Where a trigram is too rare to tell,
its shape (short words, punctuation, case and digits kept, other words reduced
to a sign) is judged the same way, then the classes of its three words, each
time leaving out the text's own end. A last word that no text holds inside,
but that begins a word of others, and a word with half a character, tag or
reference behind it make a class of their own: such trigrams are compared with
ends of that class alone.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.session import checkpointed

#: Occurrences from which a level speaks for itself.
SUPPORT = 50
#: Share of terminal occurrences below which a trigram is no end, and the one from which it surely is.
TERMINAL, SURE = 0.01, 0.02
#: Longest beginning of a word that is looked up as such; longer ones are compared behind it.
HEAD = 64

#: What a field limit or a broken transfer may have left at the end.
MARK = r"(?:\s*(?:\.\.\.|…|�|\[(?:…|\.\.\.)\]|</?\w*|&#?\w*))+\s*$"

#: Of these, what no author writes: half a character, tag or reference.
BROKEN = r"(?:�|</?\w*|&#?\w*)\s*$"

#: Names and numbers stand for their kind; a blank line is a sign of its own.
NORMAL = r"regexp_replace(regexp_replace(replace({0}, '\n\n', ' ¶ '), r'\p{{Lu}}\p{{M}}*\p{{Ll}}[^\s.,;:!?…)\]}}”“„]*', 'X'), r'[0-9]+', '0')"

TEXTS = "SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL AND trim(' \\n\\r\\t' FROM text) <> ''"

TRIGRAMS = rf"""
SELECT tri, count(*) AS n FROM (
  SELECT concat_ws(' ', z.`0`, z.`1`, z.`2`) AS tri FROM (
    SELECT explode(arrays_zip(slice(w, 1, size(w) - 2), slice(w, 2, size(w) - 2), slice(w, 3, size(w) - 2))) AS z
    FROM (SELECT split(concat('^ ^ ', trim({NORMAL.format("text")})), r'\s+') AS w FROM texts)))
GROUP BY tri
"""

#: The last words of each text; what the cut left is taken off. Only the tail is needed, which substring_index finds from the end.
FINALS = rf"""
SELECT doc_id, source, marked, broken, regexp_extract(body, r'([\p{{L}}\p{{M}}\p{{N}}’-]+)\s*$', 1) AS last_word, regexp_replace(concat_ws(' ', slice(w, size(w) - 2, 3)), r'(?<=[ (“„])\p{{Lu}}$', 'X') AS tri
FROM (
  SELECT *, split(concat('^ ^ ', trim({NORMAL.format("body")})), r'\s+') AS w
  FROM (SELECT doc_id, source, tail RLIKE r'{MARK}' AS marked, tail RLIKE r'{BROKEN}' AS broken, regexp_replace(tail, r'{MARK}', '') AS body
        FROM (SELECT doc_id, source, substring_index(trim(' \n\r\t' FROM text), ' ', -12) AS tail FROM texts)))
"""

#: Words of up to three letters stay; so do signs. SHAPE of a column tri.
SHAPE = r"regexp_replace(tri, r'\p{Ll}[\p{L}\p{M}’-]{3,}', 'x')"
#: All three words of a shape by their kind: case, digits and signs.
CLASS = r"regexp_replace(regexp_replace(shape, r'\p{Ll}[\p{L}\p{M}’-]*', 'x'), r'\p{Lu}[\p{L}\p{M}’-]*', 'X')"

#: Words inside texts: the very last of each text is taken off again, as it may be a fragment.
VOCABULARY = r"""
SELECT word, sum(n) AS n FROM (
  SELECT explode(split(token, r'[^\p{L}\p{M}\p{N}’-]+')) AS word, n FROM (
    SELECT token, sum(n) AS n FROM (
      SELECT explode(split(replace(text, '\n', ' '), ' ')) AS token, 1 AS n FROM texts
      UNION ALL
      SELECT substring_index(substring_index(trim(' \n\r\t' FROM text), ' ', -1), '\n', -1) AS token, -1 AS n FROM texts)
    GROUP BY token HAVING sum(n) > 0))
WHERE word <> '' GROUP BY word
"""

#: Last words that no text holds inside, but that begin a word of other texts. Only these last words are looked up, so a word of any length costs little.
LAST = f"SELECT last_word AS word, substring(last_word, 1, {HEAD}) AS head FROM (SELECT DISTINCT last_word FROM finals WHERE last_word <> '') LEFT ANTI JOIN vocabulary ON last_word = vocabulary.word"
FRAGMENTS = f"""
SELECT DISTINCT l.word FROM last l
JOIN (SELECT word, explode(transform(sequence(1, least(length(word), {HEAD})), k -> substring(word, 1, k))) AS head FROM vocabulary) v
  ON l.head = v.head AND startswith(v.word, l.word)
"""

#: A final trigram is odd if its last word is a fragment or broken signs follow it: a word class of its own.
FLAGGED = "SELECT f.*, g.word IS NOT NULL AS fragment, f.broken OR g.word IS NOT NULL AS odd FROM finals f LEFT JOIN fragments g ON f.last_word = g.word"

ENDS = "SELECT tri, count_if(NOT odd) AS n_plain, count_if(odd) AS n_odd, count_if(NOT marked) AS n_whole FROM flagged GROUP BY tri"
SHAPES = f"SELECT {SHAPE} AS shape, sum(n) AS n FROM trigrams GROUP BY 1"
SHAPE_ENDS = f"SELECT {SHAPE} AS shape, sum(n_plain) AS n_plain, sum(n_odd) AS n_odd, sum(n_whole) AS n_whole FROM ends GROUP BY 1"

#: How often a final trigram goes on inside texts: with more letters or a sign, apart from the end of a sentence, which an author may leave out (n), or in any way (n_all).
LONGER = r"""
SELECT f.tri, sum(CASE WHEN NOT t.ends THEN t.n ELSE 0 END) AS n, sum(t.n) AS n_all
FROM (SELECT tri, substring_index(tri, ' ', 2) AS two, left(substring_index(tri, ' ', -1), 1) AS first FROM ends WHERE NOT tri RLIKE r'[.!?]["”“)]*$') f
JOIN (SELECT tri, n, substring_index(tri, ' ', 2) AS two, left(substring_index(tri, ' ', -1), 1) AS first, tri RLIKE r'[.!?…�]["”“)]*$' AS ends FROM trigrams) t
  ON f.two = t.two AND f.first = t.first AND startswith(t.tri, f.tri) AND t.tri <> f.tri
GROUP BY f.tri
"""

CLASSES = f"SELECT {CLASS} AS class, sum(n) AS n FROM shapes GROUP BY 1"
CLASS_ENDS = f"SELECT {CLASS} AS class, sum(n_plain) AS n_plain, sum(n_odd) AS n_odd, sum(n_whole) AS n_whole FROM shape_ends GROUP BY 1"

JUDGED = f"""
SELECT f.doc_id, f.source, f.tri, f.shape, f.class, f.marked, f.broken, f.fragment, f.odd, coalesce(l.n, 0) AS n_longer, coalesce(l.n_all, 0) AS n_longer_all,
       coalesce(t.n, 0) - e.n_whole AS n_inside, CASE WHEN f.odd THEN e.n_odd ELSE e.n_plain END - 1 AS n_terminal,
       coalesce(s.n, 0) - se.n_whole AS s_inside, CASE WHEN f.odd THEN se.n_odd ELSE se.n_plain END - 1 AS s_terminal,
       coalesce(c.n, 0) - ce.n_whole AS c_inside, CASE WHEN f.odd THEN ce.n_odd ELSE ce.n_plain END - 1 AS c_terminal
FROM (SELECT *, {CLASS} AS class FROM (SELECT *, {SHAPE} AS shape FROM flagged)) f
JOIN ends e ON f.tri = e.tri
JOIN shape_ends se ON f.shape = se.shape
JOIN class_ends ce ON f.class = ce.class
LEFT JOIN longer l ON f.tri = l.tri
LEFT JOIN trigrams t ON f.tri = t.tri
LEFT JOIN shapes s ON f.shape = s.shape
LEFT JOIN classes c ON f.class = c.class
"""

#: The level of trigrams that decides: words, shapes or classes; each speaks only where it is frequent enough.
VERDICT = f"""
SELECT *, evidence LIKE 'cut %' AS cut FROM (
SELECT *,
  CASE WHEN odd AND n_longer_all > n_terminal AND NOT tri RLIKE r'[.!?]["”“)]*$' THEN 'cut by words'
       WHEN NOT odd AND n_terminal >= 5 AND n_terminal >= {SURE} * (n_inside + n_longer + n_terminal) THEN 'end by words'
       WHEN n_inside >= 20 * {SUPPORT} AND n_terminal < 0.1 * {TERMINAL} * n_inside THEN 'cut by words'
       WHEN n_longer >= {SUPPORT} AND n_terminal < {TERMINAL} * (n_inside + n_longer) THEN 'cut by words'
       WHEN s_inside >= {SUPPORT} AND s_terminal < {TERMINAL} * (s_inside + s_terminal) THEN 'cut by shapes'
       WHEN n_inside >= {SUPPORT} AND n_terminal < {TERMINAL} * (n_inside + n_terminal) AND s_terminal < {SURE} * (s_inside + s_terminal) THEN 'cut by words'
       WHEN NOT odd AND s_inside + s_terminal >= {SUPPORT} THEN 'end by shapes'
       WHEN c_inside >= {SUPPORT} AND c_terminal < {TERMINAL} * (c_inside + c_terminal) THEN 'cut by classes'
       ELSE 'end by classes' END AS evidence
FROM judged)
"""

#: The statements in the order in which each is a view of the ones before.
STEPS = {"texts": TEXTS, "trigrams": TRIGRAMS, "finals": FINALS, "vocabulary": VOCABULARY, "last": LAST, "fragments": FRAGMENTS, "flagged": FLAGGED, "ends": ENDS, "shapes": SHAPES, "longer": LONGER, "shape_ends": SHAPE_ENDS, "classes": CLASSES, "class_ends": CLASS_ENDS, "judged": JUDGED, "verdict": VERDICT}


def judge(documents: DataFrame) -> DataFrame:
    """Every non-blank document with the counts of its final trigram, the level that decided and the verdict ``cut``.

    Defined results: null and blank texts give no row; a text of fewer than
    three words is padded with a start sign; repeated doc_ids give one row
    each. Counts run over all documents and are summed map-side before the
    shuffle.
    """
    spark, run = documents.sparkSession, uuid.uuid4().hex[:8]
    names = {k: f"{k}_{run}" for k in ["documents", *STEPS]}
    documents.select("doc_id", "source", "text").createOrReplaceTempView(names["documents"])
    for step, query in STEPS.items():
        own = re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {names.get(m[2], m[2])}", query)
        own = re.sub(r"\bvocabulary\.", f"{names['vocabulary']}.", own)
        out = spark.sql(own)
        if step == "finals":  # short, and read by later steps
            out = checkpointed(out)
        out.createOrReplaceTempView(names[step])
    for view in names.values():
        spark.catalog.dropTempView(view)
    return out


def found(documents: DataFrame) -> DataFrame:
    return judge(documents).where("cut").select("doc_id").distinct()


def source_report(documents: DataFrame) -> DataFrame:
    """Per source: documents, cut documents and their share."""
    by_doc = judge(documents).groupBy("source", "doc_id").agg(F.max("cut").alias("cut"))
    return by_doc.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("cut").alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 4).alias("share"))


def coverage(documents: DataFrame) -> DataFrame:
    """(source, n_docs): texts that are judged, each once; none that is not blank is left out."""
    return judge(documents).groupBy("source").agg(F.count_distinct("doc_id").alias("n_docs"))
