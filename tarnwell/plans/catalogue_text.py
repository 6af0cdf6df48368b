"""Queries on words and pages as texts, and the same queries as DuckDB SQL, which
states what they mean by other means than the functions they go through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.analyzer import LATIN, Dictionary, lemmas_of_words
from ..functions.morphology import ENDING, LEAST, compiled, reader
from ..operators import index
from ..sources import document_pages, load
from ..sources.scratch import stored


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Each word once, stored: what is made of them asks for them several times."""
    return stored(load(spark, d, "documents").select(F.explode(LATIN.words(F.col("text"))).alias("form")).distinct(), "words")


def _forms(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary of the documents' words: endings of several kinds are cut or
    changed, and words of four letters in n are of a stop class."""
    form, n = F.col("form"), F.length("form")
    less = lambda k: F.expr(f"left(form, greatest(length(form) - {k}, 0))")
    lemma = (
        F.when((n > 4) & form.endswith("ing"), less(3)).when((n > 4) & form.endswith("ies"), F.concat(less(3), F.lit("y")))
        .when((n > 3) & form.endswith("s"), less(1)).when((n > 4) & form.endswith("aux"), F.concat(less(2), F.lit("l"))).otherwise(form)
    )
    return _words(spark, d).select("form", lemma.alias("known"), ((n == 4) & form.endswith("n")).alias("stop"))


def morphology_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Lemmas of all documents by an automaton of their words."""
    forms = _forms(spark, d)
    dictionary = Dictionary(forms, small=False).compile()
    posts = index.postings(document_pages(spark, d), LATIN, dictionary, is_html=False)
    return posts.groupBy("site_url", "lemma").agg(F.sum("rank").cast("long").alias("words"), F.count("*").alias("pages"))


def morphology_guess(spark: SparkSession, d: str) -> DataFrame:
    """Words whose digest begins with a digit from 0 to 7 are the dictionary; the
    lemmas of the others are guessed by their endings."""
    forms = _forms(spark, d).withColumn("in", F.substring(F.md5("form"), 1, 1) < "8")
    read = reader(compiled(forms.filter("in").drop("in"), guess=True), spark)
    return forms.filter("NOT in").select("form", F.col("known").alias("lemma"), read(F.col("form")).alias("r")).select("form", "lemma", F.col("r.lemma").alias("guessed"), F.col("r.known").alias("known"))


_REFERENCES = ["../x", "./y/.", "../../../z?q=/../a#/./b", "g;x=1/../y", "//other.example/./a/../b", "?only=1", "#top", "", "/a/./b/../../c/..", "http:rest", "mailto:a@b", " HTTPS://H.example/../up "]


def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    """A reference of another kind for each page, resolved from its url."""
    reference = F.element_at(F.array(*[F.lit(x) for x in _REFERENCES]), (F.col("page_id") % len(_REFERENCES) + 1).cast("int"))
    return load(spark, d, "pages").select("page_id", reference.alias("reference"), urls.resolve_href(F.col("url"), reference).alias("link"))


QUERIES = {f.__name__: f for f in (morphology_frequency, morphology_guess, resolved_references)}


_FORMS = r"""words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{Ll}]{2,}')) AS form FROM documents), forms AS (
  SELECT form, length(form) = 4 AND form LIKE '%n' AS stop, CASE
    WHEN length(form) > 4 AND form LIKE '%ing' THEN left(form, length(form) - 3) WHEN length(form) > 4 AND form LIKE '%ies' THEN left(form, length(form) - 3) || 'y'
    WHEN length(form) > 3 AND form LIKE '%s' THEN left(form, length(form) - 1) WHEN length(form) > 4 AND form LIKE '%aux' THEN left(form, length(form) - 2) || 'l' ELSE form END AS lemma
  FROM words)"""
SQL = {
    "morphology_frequency": f"""WITH {_FORMS}, ranks AS (
  SELECT d.source AS site_url, d.doc_id, f.lemma, count(*) AS n FROM (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{Ll}}]{{2,}}')) AS form FROM documents) d
  JOIN forms f USING (form) WHERE NOT f.stop GROUP BY ALL
) SELECT site_url, lemma, CAST(sum(n) AS BIGINT) AS words, count(*) AS pages FROM ranks GROUP BY ALL""",
    "morphology_guess": f"""WITH {_FORMS}, rules AS (
  SELECT form, stop, CASE WHEN lemma = form THEN 0 WHEN lemma = left(form, length(form) - 1) THEN 1 WHEN form LIKE '%ing' OR form LIKE '%ies' THEN 3 WHEN form LIKE '%aux' THEN 2 END AS cut,
    CASE WHEN starts_with(form, lemma) THEN '' WHEN form LIKE '%ies' THEN 'y' WHEN form LIKE '%aux' THEN 'l' END AS add FROM forms WHERE left(md5(form), 1) < '8'
), endings AS (
  SELECT right(form, n) AS ending, cut, add, count(*) AS c FROM rules, range(1, {ENDING + 1}) r(n) WHERE NOT stop AND n <= length(form) AND cut <= n GROUP BY ALL
), best AS (
  SELECT ending, min(ROW(-c, cut, add)) AS b FROM endings GROUP BY ending HAVING sum(c) >= {LEAST}
), unknown AS (SELECT form, lemma FROM forms WHERE left(md5(form), 1) >= '8'), met AS (
  SELECT u.form, u.lemma, max_by(b.b, length(b.ending)) AS b FROM unknown u, range(1, {ENDING + 1}) r(n) JOIN best b ON b.ending = right(u.form, n) AND n <= length(u.form) GROUP BY ALL
), cut AS (SELECT form, lemma, left(form, length(form) - b[2]) || b[3] AS guessed FROM met)
SELECT form, lemma, CASE WHEN coalesce(guessed, '') = '' THEN form ELSE guessed END AS guessed, false AS known FROM unknown LEFT JOIN cut USING (form, lemma)""",
    "resolved_references": f"""WITH asked AS (
  SELECT page_id, url, r AS reference, trim(r) AS t FROM (SELECT page_id, url, [{", ".join(f"'{r}'" for r in _REFERENCES)}][page_id % {len(_REFERENCES)} + 1] AS r FROM pages)
), base AS (
  SELECT *, regexp_extract(url, '^(https?:)', 1) AS scheme, regexp_extract(url, '^https?:(//[^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS folder, regexp_extract(url, '([?][^#]*)', 1) AS query FROM asked
), target AS (
  SELECT page_id, reference, CASE WHEN t LIKE 'mailto:%' THEN NULL WHEN lower(t) LIKE 'https://%' THEN left(t, 6) WHEN t = 'http:rest' THEN 'http:' ELSE scheme END AS scheme,
    CASE WHEN lower(t) LIKE 'https://%' THEN '//H.example' WHEN t LIKE '//%' THEN '//other.example' WHEN t = 'http:rest' THEN '' ELSE host END AS host,
    CASE WHEN lower(t) LIKE 'https://%' THEN '/../up' WHEN t LIKE '//%' THEN substr(t, 16) WHEN t = 'http:rest' THEN 'rest' WHEN t = '' OR t[1] IN ('?', '#') THEN folder
      WHEN t LIKE '/%' THEN t WHEN folder = '' THEN '/' || regexp_replace(t, '[?#].*', '') ELSE regexp_replace(folder, '[^/]*$', '') || regexp_replace(t, '[?#].*', '') END AS path,
    t = '' OR t[1] IN ('?', '#') AS same,
    CASE WHEN t = '' THEN query WHEN t LIKE '#%' THEN query || t WHEN t LIKE '?%' THEN t WHEN t LIKE '../../../z%' THEN '?q=/../a#/./b' ELSE '' END AS rest FROM base
), segments AS (
  SELECT *, string_split(path, '/') AS s FROM target
), folded AS (
  SELECT *, list_reduce(list_transform(s, lambda x: [x]), lambda a, b: CASE WHEN b[1] = '.' THEN a WHEN b[1] = '..' THEN CASE WHEN len(a) > 1 THEN a[1:len(a) - 1] ELSE a END ELSE list_concat(a, b) END) AS kept FROM segments
) SELECT page_id, reference, CASE WHEN scheme IS NULL THEN '' ELSE scheme || host || CASE WHEN same OR path NOT LIKE '/%' THEN path
    ELSE CASE WHEN len(kept) = 1 THEN '/' ELSE array_to_string(kept, '/') || CASE WHEN s[len(s)] IN ('.', '..') THEN '/' ELSE '' END END END || rest END AS link FROM folded""",
}
