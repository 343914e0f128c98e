"""Text functions, word filters, vocabulary and page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.web import CONTAINERS, FOREIGN, STRUCTURE
from ..operators import filters as fl
from ..operators import terms as te
from ..operators.rows import array_rows
from ..operators.stopping import without_stop_words
from ..session import cut_lineage, spread
from .registry import CORPUS, on_corpus, query
from .views import STOP, corpus, filtered_words, table, titles, tokenized

_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"


def words_sql(text: str) -> str:
    """SQL of split_words."""
    return (
        rf"CASE WHEN regexp_full_match({text}, '\s+') THEN []::VARCHAR[] ELSE "
        rf"string_split_regex(regexp_replace(lower({text}), '\s+$', ''), '\s') END"
    )


def kept_sql(words: str, letters: bool = True) -> str:
    """SQL of token_filter."""
    test = r"regexp_full_match(w, '\p{L}+') AND " if letters else ""
    return f"list_filter({words}, lambda w: length(w) > 3 AND {test}w NOT IN {_STOP_SQL})"


def sentences_sql(text: str) -> str:
    """SQL of sentences: an array of word arrays."""
    marked = rf"regexp_replace(regexp_replace(lower({text}), '[.?!]\s+', '~~', 'g'), '[.?!]$', '')"
    last = "list_max(list_transform(string_split({m}, '~~'), lambda x, i: CASE WHEN x <> '' THEN i ELSE 0 END))"
    parts = (
        f"CASE WHEN {marked} = '' THEN ['']::VARCHAR[] ELSE "
        f"list_slice(string_split({marked}, '~~'), 1, {last.format(m=marked)}) END"
    )
    bare = """regexp_replace(s, '[\\[\\]“”():,‘’"]', '', 'g')"""
    cut = (
        rf"CASE WHEN regexp_full_match({bare}, '\s+') THEN []::VARCHAR[] ELSE "
        rf"string_split_regex(regexp_replace({bare}, '\s+$', ''), '\s+') END"
    )
    keep = r"regexp_matches(w, '\p{L}') OR regexp_full_match(w, '\p{Nd}*')"
    return f"list_transform({parts}, lambda s: list_filter({cut}, lambda w: {keep}))"


def title_tokens_sql(text: str = "title") -> str:
    return f"flatten({sentences_sql(text)})"


TITLES = f"""{CORPUS},
titles AS (SELECT id, {title_tokens_sql()} AS words FROM corpus)"""
TOKENIZED = f"""{CORPUS},
tokenized AS (SELECT id, {kept_sql(words_sql('text'))} AS words FROM corpus)"""
TERMS = f"""{TOKENIZED},
terms AS (SELECT id, unnest(words) AS term FROM tokenized),
term_counts AS (SELECT term, count(*) AS n FROM terms GROUP BY 1)"""
DROP_TOP = 100
VOCAB = f"""{TERMS},
ranked AS (SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS r FROM term_counts),
vocab AS (SELECT term, n, r - {DROP_TOP + 1} AS idx FROM ranked WHERE r > {DROP_TOP})"""


def joined(words, sep="|"):
    return F.array_join(words, sep)


def term_table(spark, root):
    """``id, term`` of the filtered words of all documents."""
    docs = corpus(spark, root)
    return te.term_rows(docs, "id", tx.split_words(F.col("text")), STOP)


def vocabulary(spark, root, min_count=1):
    counts = te.count_terms(term_table(spark, root))
    return te.vocabulary(counts, DROP_TOP, min_count)


@query(
    "titles_nonempty",
    f"WITH {TITLES} SELECT id, array_to_string(words, '|') AS words, len(words) AS n_words "
    "FROM titles JOIN corpus USING (id) WHERE title <> '' AND len(words) > 0",
)
def titles_nonempty(spark, root):
    kept = fl.titles_nonempty(corpus(spark, root))
    return kept.select("id", joined("words").alias("words"), F.size("words").cast("bigint").alias("n_words"))


_ESCAPED_SQL = r"""'\u0041 \\r\t' || replace(replace(text, '"', '\"'), chr(10), '\n\n') || ' "end"'"""


def _escaped(text):
    line = F.replace(F.replace(text, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n\\n"))
    return F.concat(F.lit("\\u0041 \\\\r\\t"), line, F.lit(' "end"'))


_CLEAN_SQL = (
    r"replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, "
    r"'\\n+', ' ', 'g'), '\\r+', ' ', 'g'), '\\t+', ' ', 'g'), '\s+', ' ', 'g'), '\u', ''), "
    """'\\"', ''), '"', '')"""
)


@query(
    "text_clean", on_corpus(f"SELECT id, {_CLEAN_SQL.format(f'({_ESCAPED_SQL})')} AS cleaned FROM corpus")
)
def text_clean(spark, root):
    return corpus(spark, root).select("id", tx.text_clean(_escaped(F.col("text"))).alias("cleaned"))


_LINE_SQL = f"""CASE WHEN id % 5 = 0 THEN {_ESCAPED_SQL}
  ELSE '{{"webpage":"' || {_ESCAPED_SQL} || '","HNItem":{{"objectID":' || id || '}}}}' END"""


@query(
    "article_cut",
    on_corpus(
        f""", raw AS (SELECT id, {_LINE_SQL} AS line FROM corpus),
        parts AS (SELECT id, CASE WHEN contains(line, '"webpage":"')
          THEN split_part(split_part(line, '"webpage":"', 2), '","HNItem"', 1) ELSE line END AS part FROM raw)
        SELECT id, {_CLEAN_SQL.format('part')} AS article FROM parts"""
    ),
)
def article_cut(spark, root):
    text = _escaped(F.col("text"))
    tail = F.concat(F.lit('","HNItem":{"objectID":'), F.col("id").cast("string"), F.lit("}}"))
    line = F.when(F.col("id") % 5 == 0, text).otherwise(F.concat(F.lit('{"webpage":"'), text, tail))
    return corpus(spark, root).select("id", tx.article_cut(line).alias("article"))


@query(
    "split_words",
    on_corpus(
        f"SELECT id, array_to_string({words_sql('text')}, '|') AS words, "
        f"len({words_sql('text')}) AS n_words FROM corpus"
    ),
)
def split_words(spark, root):
    words = tx.split_words(F.col("text"))
    return corpus(spark, root).select(
        "id", joined(words).alias("words"), F.size(words).cast("bigint").alias("n_words")
    )


@query(
    "sentences",
    on_corpus(
        f""", cut AS (SELECT id, {sentences_sql('text')} AS s FROM corpus),
        rows AS (SELECT id, unnest(s) AS words, unnest(range(len(s))) AS pos FROM cut)
        SELECT id, pos, array_to_string(words, '|') AS words FROM rows"""
    ),
)
def sentences(spark, root):
    every = F.posexplode_outer(tx.sentences(F.col("text"))).alias("pos", "words")
    rows = corpus(spark, root).select("id", every).filter(F.col("pos").isNotNull())
    return rows.select("id", F.col("pos").cast("bigint").alias("pos"), joined("words").alias("words"))


@query(
    "title_tokens", f"WITH {TITLES} SELECT id, array_to_string(words, '|') AS words FROM titles"
)
def title_tokens(spark, root):
    return titles(spark, root).select("id", joined("words").alias("words"))


@query(
    "ascii_normalize",
    on_corpus("SELECT id, regexp_replace(lower(text), '[^a-z0-9.]+', ' ', 'g') AS plain FROM corpus"),
)
def ascii_normalize(spark, root):
    return corpus(spark, root).select("id", tx.ascii_normalize(F.col("text")).alias("plain"))


@query("token_filter", f"WITH {TOKENIZED} SELECT id, array_to_string(words, ' ') AS words FROM tokenized")
def token_filter(spark, root):
    return tokenized(spark, root).select("id", tx.words_to_text(F.col("words")).alias("words"))


@query(
    "stop_table",
    f"""WITH {TOKENIZED}, stop AS (SELECT DISTINCT unnest({title_tokens_sql()}) AS word FROM corpus),
    rows AS (SELECT id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM tokenized),
    kept AS (SELECT id, string_agg(word, ' ' ORDER BY pos) AS words FROM rows ANTI JOIN stop USING (word) GROUP BY 1)
    SELECT id, coalesce(kept.words, '') AS words FROM tokenized LEFT JOIN kept USING (id)""",
)
def stop_table(spark, root):
    """Words of the texts that are in no title: the title words are a stop table behind its Bloom filter."""
    stop = array_rows(titles(spark, root), "id", F.col("words"), "word").select("word").distinct()
    kept = without_stop_words(tokenized(spark, root), "id", "words", stop, max_words=0)
    return kept.select("id", tx.words_to_text(F.col("words")).alias("words"))


_LOOSE = kept_sql("string_split(regexp_replace(lower(text), '[^a-z0-9.]+', ' ', 'g'), ' ')", letters=False)


@query("token_filter_loose", on_corpus(f"SELECT id, array_to_string({_LOOSE}, ' ') AS words FROM corpus"))
def token_filter_loose(spark, root):
    words = F.split(tx.ascii_normalize(F.col("text")), " ")
    kept = tx.token_filter(words, STOP, letters_only=False)
    return corpus(spark, root).select("id", tx.words_to_text(kept).alias("words"))


_SUFFIX_SQL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, 'ies$', 'y'), "
    r"'sses$', 'ss'), '([^s])s$', '\1'), '(.{3})ing$', '\1'), '(.{3})ed$', '\1')"
)


@query(
    "term_normalize",
    f"""WITH {TOKENIZED},
    dictionary AS (SELECT DISTINCT w AS form, left(w, 5) AS base FROM (
      SELECT unnest({title_tokens_sql()}) AS w FROM corpus) WHERE length(w) > 8),
    rows AS (SELECT id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM tokenized),
    based AS (SELECT id, pos, coalesce(base, {_SUFFIX_SQL}) AS base
              FROM rows LEFT JOIN dictionary ON form = word),
    texts AS (SELECT id, string_agg(base, ' ' ORDER BY pos) AS words FROM based GROUP BY 1)
    SELECT id, coalesce(texts.words, '') AS words FROM tokenized LEFT JOIN texts USING (id)""",
)
def term_normalize(spark, root):
    words = array_rows(titles(spark, root), "id", F.col("words"), "form")
    forms = words.filter(F.length("form") > 8).select("form").distinct()
    dictionary = cut_lineage(forms.withColumn("base", F.substring("form", 1, 5)), "dictionary")
    done = te.term_normalize(tokenized(spark, root), "id", "words", dictionary)
    return done.select("id", tx.words_to_text(F.col("words")).alias("words"))


@query("term_counts", f"WITH {TERMS} SELECT term, n FROM term_counts ORDER BY n DESC, term")
def term_counts(spark, root):
    return te.term_counts(term_table(spark, root))


@query("vocab_trimmed", f"WITH {VOCAB} SELECT term, n FROM vocab")
def vocab_trimmed(spark, root):
    return te.vocab_trimmed(te.count_terms(term_table(spark, root)), DROP_TOP)


@query("vocab_index", f"WITH {VOCAB} SELECT term, n, idx FROM vocab")
def vocab_index(spark, root):
    return vocabulary(spark, root)


@query(
    "bag_of_words",
    f"WITH {VOCAB} SELECT id, idx, count(*) AS n FROM terms JOIN vocab USING (term) GROUP BY ALL",
)
def bag_of_words(spark, root):
    return te.bag_of_words(tokenized(spark, root), "id", "words", vocabulary(spark, root))


@query(
    "article_word_counts",
    on_corpus(f"SELECT id, CAST(len({words_sql('text')}) AS INTEGER) AS n_words FROM corpus"),
)
def article_word_counts(spark, root):
    docs = corpus(spark, root).select("id", tx.split_words(F.col("text")).alias("words"))
    return te.article_word_counts(docs)


def _marked_sql(html: str) -> str:
    """A page without raw parts and inline tags; marks 1 and 2 are around structural tags, 3 and 4 around links."""
    out = rf"regexp_replace({html}, '(?s)<!--.*?(?:-->|\z)', ' ', 'g')"
    for tag in ("script", "style", "title"):
        out = rf"regexp_replace({out}, '(?is)<{tag}\b.*?(?:</{tag}>|\z)', ' ', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '(?i)<a\b[^<>]*>', chr(3), 'g'), '(?i)</a\s*>', chr(4), 'g')"
    out = rf"regexp_replace({out}, '{STRUCTURE}', chr(1) || '\1\2' || chr(2), 'g')"
    return rf"chr(2) || regexp_replace({out}, '<[^<>]*>', ' ', 'g')"


def _plain_sql(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for entity, plain in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "),
        ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
    ):
        out = f"replace({out}, '{entity}', '{plain}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


_CONTAINERS_SQL, _FOREIGN_SQL = (", ".join(f"'{t}'" for t in tags) for tags in (CONTAINERS, FOREIGN))
MAIN_TEXTS = f"""split AS (SELECT page_id, string_split({_marked_sql('html')}, chr(1)) AS pieces FROM pages),
pieces AS (SELECT page_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS pos FROM split),
parts AS (SELECT page_id, pos, lower(split_part(piece, chr(2), 1)) AS tag, split_part(piece, chr(2), 2) AS raw FROM pieces),
named AS (SELECT *, ltrim(tag, '/') AS name, CASE WHEN tag LIKE '/%' THEN -1 ELSE 1 END AS way,
  {_plain_sql("translate(raw, chr(3) || chr(4), '  ')")} AS text,
  length(array_to_string(regexp_extract_all(raw, chr(3) || '[^' || chr(4) || ']*' || chr(4)), '')) * 2 > length(raw) AS linked FROM parts),
deep AS (SELECT *, sum(CASE WHEN name IN ({_CONTAINERS_SQL}) THEN way ELSE 0 END) OVER w AS depth,
  sum(CASE WHEN name IN ({_FOREIGN_SQL}) THEN way ELSE 0 END) OVER w AS foreign_depth
  FROM named WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
opened AS (SELECT page_id, pos, depth FROM deep WHERE way = 1 AND name IN ({_CONTAINERS_SQL}) UNION ALL SELECT page_id, 0, 0 FROM pages),
blocks AS (SELECT page_id, pos, text, len(string_split(text, ' ')) AS words, depth FROM deep
  WHERE len(string_split(text, ' ')) >= 5 AND NOT linked AND foreign_depth = 0),
shares AS (SELECT b.page_id, b.pos, o.depth, max(o.pos) AS node, any_value(CASE WHEN o.depth = b.depth THEN 2 * words ELSE words END) AS score
  FROM blocks b JOIN opened o ON o.page_id = b.page_id AND o.pos <= b.pos AND o.depth IN (b.depth, b.depth - 1) GROUP BY ALL),
best AS (SELECT page_id, node, depth FROM shares GROUP BY page_id, node, depth
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY sum(score) DESC, node) = 1),
ended AS (SELECT b.page_id, node, coalesce(min(d.pos), 1000000000) AS over FROM best b
  LEFT JOIN deep d ON d.page_id = b.page_id AND d.pos > node AND d.depth < b.depth GROUP BY ALL),
main_texts AS (SELECT page_id, string_agg(text, chr(10) ORDER BY pos) AS main FROM blocks JOIN ended USING (page_id)
  WHERE pos >= node AND pos < over GROUP BY 1)"""


def _meta_sql(attribute: str, value: str) -> str:
    pattern = (
        f"""(?is)<meta\\b[^>]*\\b{attribute}=["'']{value}["''][^>]*\\bcontent=["'']([^"'']*)["'']"""
    )
    return _plain_sql(f"regexp_extract(html, '{pattern}', 1)")


PAGE_TEXTS = f"""{MAIN_TEXTS},
page_texts AS (
  SELECT page_id, {_plain_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
         {_meta_sql('name', 'description')} AS "metaDescription",
         {_meta_sql('name', 'keywords')} AS "metaKeywords",
         coalesce(main, '') AS "cleanedText",
         coalesce(nullif(regexp_extract(html, '(?is)<link\\b[^>]*\\brel="canonical"[^>]*\\bhref="([^"]*)"', 1), ''),
                  url) AS "finalUrl",
         {_meta_sql('property', 'og:image')} AS "topImage"
  FROM pages LEFT JOIN main_texts USING (page_id) WHERE url <> '' AND url NOT LIKE '%.pdf')"""


def _pages(spark, root):
    return spread(table(spark, root, "pages"), "page_id")


@query("webpage_extract", f"WITH {PAGE_TEXTS} SELECT * FROM page_texts")
def webpage_extract(spark, root):
    return fl.webpage_extract(_pages(spark, root))


@query(
    "extract_outcomes",
    f"""WITH {MAIN_TEXTS} SELECT CASE WHEN url = '' OR url LIKE '%.pdf' THEN 'skipped_url' WHEN html IS NULL THEN 'failed_get'
        WHEN html = '' THEN 'failed_read' WHEN main IS NULL THEN 'empty_extract' ELSE 'success' END
        AS outcome, count(*) AS n FROM pages LEFT JOIN main_texts USING (page_id) GROUP BY 1""",
)
def extract_outcomes(spark, root):
    return fl.extract_outcomes(_pages(spark, root))
