"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over threshold, reassemble.

A line is normalised by lower-casing, turning runs of blanks into one and trimming. Lines whose normal form is empty (or
has fewer than ``min_chars`` characters, for callers that want that) are never dropped, nor counted. A line found in more
than ``max_documents`` distinct documents is dropped everywhere it stands; the other lines keep order and spelling: a text
is put together again from the stretches between the places of what is dropped.

That takes a text from all its copies when there are more than ``max_documents``. With ``keep_one``, for stages that are
followed by one that drops copies, documents of the same text count as one, and a frequent line stays in one text, in all
its copies: that of the smallest id. So exact copies stay exact copies, and no line goes from all documents.

Defined results
- null or empty text: kept as it is. A text all of whose lines go becomes the empty string (the row stays).
- very long texts, of any number of lines: whole, in time in proportion to their lines.
- null id: its lines count for no document, but frequent lines go from it too. Rows that share an id are one document.
- repeated rows: the same result for each. Texts are told apart by 96 bits of two hashes, lines by 64.
- Ties don't arise: only counts against a threshold matter; with keep_one, of texts that share the smallest id the one of
  the smallest hash has the line. A text whose rows all have null ids is never the one that keeps it. An empty table gives an empty one. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import c, cut, fresh

MAX_DOCUMENTS, MIN_CHARS = 10, 1


def normalised(line: Column) -> Column:
    return F.btrim(F.lower(F.regexp_replace(line, "[ \\t\\r]+", " ")), F.lit(" "))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k, k2, h): of each row its id, two hashes of its text, and of each line its hash, or null where the line is too
    short to be judged."""
    lines = F.transform(F.split(c(text_col), "\n", -1), normalised)
    hashes = F.transform(lines, lambda x: F.when(F.length(x) >= min_chars, F.xxhash64(x)))
    return docs.select(c(id_col).alias("id"), F.xxhash64(c(text_col)).alias("k"), F.hash(c(text_col)).alias("k2"), hashes.alias("h"))


def frequent_lines(hashes: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(h, n): hashes of lines in more than max_documents distinct documents. Counting is in two steps, so that a line
    of very many documents is first spread by document and then summed per task before it meets on one task."""
    lines = hashes.where("id is not null").select("id", F.explode(F.array_distinct("h")).alias("h")).where("h is not null")
    return lines.distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > max_documents)


def kept_lines(hashes: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(h, keeper): hashes of lines in more than max_documents documents of different texts, each text counting for its
    smallest id, and the text that keeps the line."""
    texts = hashes.where("id is not null").groupBy("k", "k2").agg(F.min("id").alias("id"), F.first("h").alias("h"))
    lines = texts.select(F.struct("k", "k2").alias("k"), "id", F.explode(F.array_distinct("h")).alias("h")).where("h is not null").groupBy("h", "id").agg(F.min("k").alias("k"))
    counted = lines.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("id", "k")).alias("least"))
    return counted.where(F.col("n") > max_documents).select("h", F.col("least.k").alias("keeper"))


def between(lines: Column, gone: Column) -> Column:
    """The lines at other places than those gone, which are in order: the stretches between them, one after another."""
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1)
    end = lambda i: F.when(i == F.size(gone), F.size(lines)).otherwise(F.get(gone, i))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i))))


def line_dedup(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", keep_one: bool = False) -> DataFrame:
    """docs with ``text_col`` rebuilt, and two more columns: lines_in, lines_dropped (named afresh where they clash)."""
    key, key2, places, lines = (fresh(docs, x) for x in ("key_", "key2_", "places_", "lines_"))
    # texts are read and normalised once for their hashes, a few bytes a line
    hashes = cut(line_hashes(docs, min_chars, id_col, text_col))
    # of copies of a text the lines stand once
    stand = hashes.select("k", "k2", F.posexplode("h").alias("place", "h")).where("h is not null").distinct()
    if keep_one:
        frequent = stand.join(kept_lines(hashes, max_documents), "h").where("k <> keeper.k or k2 <> keeper.k2")
    else:
        frequent = stand.join(frequent_lines(hashes, max_documents).select("h"), "h", "left_semi")
    gone = (
        frequent.groupBy("k", "k2")
        .agg(F.sort_array(F.collect_list("place")).alias("places"))
        .select(F.col("k").alias(key), F.col("k2").alias(key2), F.col("places").alias(places))
    )
    return (
        docs.withColumns({key: F.xxhash64(c(text_col)), key2: F.hash(c(text_col))})
        .join(gone, [key, key2], "left")
        .withColumn(lines, F.split(c(text_col), "\n", -1))
        .select(
            *[F.when(c(places).isNull(), c(text_col)).otherwise(F.array_join(between(c(lines), c(places)), "\n")).alias(n) if n == text_col else c(n) for n in docs.columns],
            F.when(c(text_col).isNull(), 0).otherwise(F.size(c(lines))).cast("long").alias(fresh(docs, "lines_in")),
            F.when(c(places).isNull(), 0).otherwise(F.size(c(places))).cast("long").alias(fresh(docs, "lines_dropped")),
        )
    )


#: The same over DuckDB's tables; its result is that of the query op10_line_dedup.
SQL = f"""
with l as (
  select doc_id, i, line, trim(lower(regexp_replace(line, '[ \t\r]+', ' ', 'g')), ' ') as norm
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
), f as (
  select norm from l where length(norm) >= {MIN_CHARS} group by norm having count(distinct doc_id) > {MAX_DOCUMENTS}
), k as (select l.*, f.norm is null as stays from l left join f using (norm))
select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where stays), '') as text,
  count(*)::bigint as lines_in, count(*) filter (where not stays)::bigint as lines_dropped
from k group by doc_id
"""
