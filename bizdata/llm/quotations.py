"""Conversations in reply order without quotes, by linking quoted passages to the messages they come from.

Column expressions only: lines are split and their quote levels read with regular expressions, quoted and own
lines are hashed in a normal form, and the hashes are joined. A quoted line that no message has as a line, because
it was wrapped anew or is part of one, is looked up in runs of words of the passages that lines make up.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle

QUOTE = r"^[ \t]*(?:>[ \t]?)*>"
#: Words of a run; a passage of fewer words is one run.
RUN = 5
ATTRIBUTION = r"(?i)^[ \t]*(?:on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,100}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió)[ \t]*:[ \t]*$"


def level(line: Column) -> Column:
    """How many quote marks a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", ""))


def normal(passage: Column) -> Column:
    """Lower case, letters and digits only, one space between words."""
    return F.trim(F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}]+", " "))


def lines_of(messages: DataFrame) -> DataFrame:
    """One row per line that holds a letter or digit: `level`, `at` (line number), `line` without quote marks, `passage`
    (normal form), `hash`. Levels are taken as written; lines that announce a quote are left out."""
    split = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n", -1)
    return (messages.select("conv_id", "turn", F.xxhash64("text").alias("text_hash"), F.posexplode(split).alias("at", "raw"))
            .withColumn("level", level(F.col("raw")))
            .withColumn("line", F.regexp_replace("raw", QUOTE + "[ \t]?", ""))
            .withColumn("passage", normal(F.col("line"))).where(F.col("passage") != "")
            .where(~F.col("line").rlike(ATTRIBUTION))
            .withColumn("hash", F.xxhash64("passage")))


def runs_of(lines: DataFrame) -> DataFrame:
    """One row per run of RUN successive words of a passage, the successive lines of one level in a message: `run`
    (normal form), `run_hash`, and `lines`, the numbers of the lines that the run touches. A passage of fewer words
    is one run."""
    message, passage = ["conv_id", "turn", "text_hash"], ["conv_id", "turn", "text_hash", "part"]
    parts = (lines.select(*message, "level", "at", "passage").distinct()
             .withColumn("new", F.coalesce(F.col("level") != F.lag("level").over(Window.partitionBy(*message).orderBy("at")), F.lit(True)))
             .withColumn("part", F.sum(F.col("new").cast("int")).over(Window.partitionBy(*message).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))))
    words = parts.select(*passage, "level", "at", F.posexplode(F.split("passage", " ")).alias("k", "word"))
    order = Window.partitionBy(*passage).orderBy("at", "k")
    found = words.select(*passage, "level", "at", F.row_number().over(order).alias("place"), F.collect_list(F.struct("at", "word")).over(order.rowsBetween(0, RUN - 1)).alias("held"))
    return (found.where((F.size("held") == RUN) | (F.col("place") == 1))
            .select("conv_id", "turn", "level", F.array_join(F.col("held.word"), " ").alias("run"), F.array_distinct(F.col("held.at")).alias("lines"))
            .withColumn("run_hash", F.xxhash64("run")))


def link_runs(lines: DataFrame, unlinked: DataFrame) -> DataFrame:
    """For quoted lines without a source (`unlinked`), the earlier message that most runs touching the line come from
    (ties: the first): `conv_id`, `turn`, `level`, `at`, `by_run`. Only their conversations are cut into runs."""
    own = lines.where(F.col("level") == 0).join(unlinked.select("conv_id").distinct(), "conv_id", "left_semi")
    said = runs_of(own).groupBy("conv_id", "run_hash", "run").agg(F.min("turn").alias("source"))
    quoting = lines.join(unlinked.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_semi")
    return (runs_of(quoting).where(F.col("level") > 0).join(said, ["conv_id", "run_hash", "run"]).where(F.col("source") < F.col("turn"))
            .select("conv_id", "turn", "level", F.explode("lines").alias("at"), "source")
            .groupBy("conv_id", "turn", "level", "at", "source").agg(F.count("*").alias("n"))
            .groupBy("conv_id", "turn", "level", "at").agg(F.max_by("source", F.struct("n", -F.col("source"))).alias("by_run")))


def own_text(text: Column) -> Column:
    """A message without quoted lines and without the line that announces a quote."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)
    kept = F.filter(lines, lambda x: ~x.rlike(QUOTE) & ~x.rlike(ATTRIBUTION))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def turns_before(messages: DataFrame, span: int = 1024) -> DataFrame:
    """conv_id, turn and `before`, the greatest earlier turn of the conversation. Turns are looked back from within spans of
    turn numbers, and from the first turn of a span to the last one of the span before, so that a conversation
    with most of the messages is many groups."""
    turns = messages.select("conv_id", "turn", F.floor(F.col("turn") / span).alias("span")).distinct()
    inner = turns.withColumn("near", F.lag("turn").over(Window.partitionBy("conv_id", "span").orderBy("turn")))
    ends = turns.groupBy("conv_id", "span").agg(F.max("turn").alias("last"))
    ends = ends.select("conv_id", "span", F.lag("last").over(Window.partitionBy("conv_id").orderBy("span")).alias("far"))
    return inner.join(ends, ["conv_id", "span"], "left").select("conv_id", "turn", F.coalesce("near", "far").alias("before"))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: `conv_id`, `turn`, `role`, `body` (without quotes), `reply_to` (turn answered), `n_quoted`
    (quoted lines), `n_linked` (those found in an earlier message of the conversation).

    A quoted line's source is the first message of its conversation that has that line as its own, in normal form; the
    texts are compared after the hashes. A line that has none so takes the message that most runs of RUN words touching
    it come from, runs of the passage that successive lines of one level make up; so quotes that were wrapped anew
    and parts of lines are found, from RUN words on or if they are a whole passage. LINK_SQL has the rule for whole
    lines only and agrees where no quote needs runs. A message answers the source of most of its outermost quoted lines (ties:
    the later one); without a source, the greatest earlier turn of the conversation, if there is one; else it begins a thread (null). Sorting
    a conversation by reply_to (nulls first) and turn puts every message after the one it answers and replies to
    one message together; `reply_order` gives that order without gathering a conversation in one task.

    Null texts are empty; rows with a null conversation or turn come out without links; rows that repeat conversation
    and turn come out each, linked alike; empty tables give no rows; other columns are ignored.
    Sources are minima of (conversation, line), aggregated before the shuffle, so a line that most messages share
    is one row; the join of quotes with them can be split on a hot key.
    """
    chosen = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    placed = chosen.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    # only conversations in which some line starts with a quote mark are parsed, and their lines once
    quoting = placed.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id").distinct()
    lines = settle(lines_of(placed.join(quoting, "conv_id", "left_semi")))
    quoted = lines.where(F.col("level") > 0).select("conv_id", "turn", "level", "at", "hash", "passage").distinct()
    sources = (lines.where(F.col("level") == 0).groupBy("conv_id", "hash", "passage").agg(F.min("turn").alias("source")))
    found = (quoted.join(sources, ["conv_id", "hash", "passage"], "left")
             .withColumn("source", F.when(F.col("source") < F.col("turn"), F.col("source"))))
    by_run = link_runs(lines, found.where(F.col("source").isNull()))
    found = found.join(by_run, ["conv_id", "turn", "level", "at"], "left").withColumn("source", F.coalesce("source", "by_run"))
    outer = found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quoted"), F.count("source").alias("n_linked"), F.min(F.when(F.col("source").isNotNull(), F.col("level"))).alias("outer"))
    votes = (found.where(F.col("source").isNotNull()).groupBy("conv_id", "turn", "level", "source").agg(F.count("*").alias("votes"))
             .groupBy("conv_id", "turn", "level").agg(F.max_by("source", F.struct("votes", "source")).alias("answered"))
             .groupBy("conv_id", "turn").agg(F.min_by("answered", "level").alias("answered")))
    before = turns_before(placed)
    return (chosen.join(outer.drop("outer"), ["conv_id", "turn"], "left").join(votes, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
            .select("conv_id", "turn", "role", own_text(F.col("text")).alias("body"),
                    F.coalesce("answered", "before").alias("reply_to"),
                    F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")))


def reply_order(linked: DataFrame) -> DataFrame:
    """The rows of link_quotes sorted into conversations in reply order, over ranges of keys."""
    return linked.orderBy("conv_id", F.col("reply_to").asc_nulls_first(), "turn")


#: The rule for whole lines in DuckDB over the table `conversations`.
LINK_SQL = r"""
WITH lines AS (
  SELECT DISTINCT conv_id, turn, unnest(generate_series(1, len(parts))) AS line_no, unnest(parts) AS raw
  FROM (SELECT conv_id, turn, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS parts
        FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
parsed AS (
  SELECT conv_id, turn, line_no, length(regexp_replace(regexp_extract(raw, '^[ \t]*(?:>[ \t]?)*>'), '[^>]', '', 'g')) AS level,
    regexp_replace(raw, '^[ \t]*(?:>[ \t]?)*>[ \t]?', '') AS line,
    trim(regexp_replace(lower(regexp_replace(raw, '^[ \t]*(?:>[ \t]?)*>[ \t]?', '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS passage FROM lines),
used AS (SELECT * FROM parsed WHERE passage <> '' AND NOT regexp_matches(line,
    '(?i)^[ \t]*(?:on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,100}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió)[ \t]*:[ \t]*$')),
sources AS (SELECT conv_id, passage, min(turn) AS source FROM used WHERE level = 0 GROUP BY ALL),
found AS (SELECT q.conv_id, q.turn, q.level, q.line_no, CASE WHEN s.source < q.turn THEN s.source END AS source
          FROM (SELECT DISTINCT conv_id, turn, level, line_no, passage FROM used WHERE level > 0) q LEFT JOIN sources s USING (conv_id, passage)),
totals AS (SELECT conv_id, turn, count(*) AS n_quoted, count(source) AS n_linked FROM found GROUP BY ALL),
votes AS (SELECT conv_id, turn, level, source, count(*) AS votes FROM found WHERE source IS NOT NULL GROUP BY ALL),
answers AS (SELECT conv_id, turn, first(source ORDER BY level, votes DESC, source DESC) AS answered FROM votes GROUP BY ALL),
befores AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL))
SELECT c.conv_id, c.turn, c.role,
  regexp_replace(array_to_string(list_filter(string_split(regexp_replace(coalesce(c.text, ''), '\r\n?', chr(10), 'g'), chr(10)),
    lambda x: NOT regexp_matches(x, '^[ \t]*(?:>[ \t]?)*>') AND NOT regexp_matches(x,
    '(?i)^[ \t]*(?:on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,100}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió)[ \t]*:[ \t]*$')), chr(10)), '^\s+|\s+$', '', 'g') AS body,
  coalesce(a.answered, b.before) AS reply_to, coalesce(t.n_quoted, 0) AS n_quoted, coalesce(t.n_linked, 0) AS n_linked
FROM conversations c LEFT JOIN totals t ON c.conv_id = t.conv_id AND c.turn = t.turn
LEFT JOIN answers a ON c.conv_id = a.conv_id AND c.turn = a.turn LEFT JOIN befores b ON c.conv_id = b.conv_id AND c.turn = b.turn
"""
