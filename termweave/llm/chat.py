r"""Chat formatting of reply trees (native).

Messages name their parent. Iterative self-joins double the distance that each message sees towards its root, so a tree of
depth d takes log2(d) rounds; they carry keys and scores, never texts. Leaves are ranked within their tree by the summed
score of their path, and the chosen paths are listed by walking the same jumps back down. Each becomes one conversation:

    <|im_start|>role\ntext<|im_end|>\n        (for each turn)

In texts every ``<``, any backslashes and ``|`` get one more backslash before the ``|``, so no text holds ``<|``; taking it
out again restores the text. Roles are treated so too, after ``%`` and newline became %25 and %0A. loss_spans are the
assistant texts as (start, length) in code points of the formatted conversation.

Defined results: null roles and texts are empty; a null tree id is a tree like another; a message whose parent is null,
missing or itself without an id in the tree is a root; messages on a cycle of parents have no root and are on no path;
repeated rows of one tree and message id are one message, the least by parent, score, role and text; ties between branches
go to the deeper and then to the leaf of smaller id; an empty table gives an empty result. Extra columns take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _same(a: DataFrame, b: DataFrame, *pairs: tuple[str, str]) -> Column:
    on = F.lit(True)
    for x, y in pairs:
        on = on & a[x].eqNullSafe(b[y])
    return on


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """t, leaf, n, depth: each message on the best ``branches`` root-to-leaf paths of each tree. nodes has t, n, p (parent) and s (score)."""
    parents = nodes.select(F.col("t").alias("pt"), F.col("n").alias("pn")).filter("pn is not null")
    there = nodes.join(parents, nodes.t.eqNullSafe(F.col("pt")) & (nodes.p == F.col("pn")), "left")
    jump = staged(there.select("t", "n", F.col("pn").alias("anc"), F.col("pn").isNotNull().cast("long").alias("hops"), F.coalesce("s", F.lit(0.0)).cast("double").alias("total")), "chat-jumps")
    first, jumps, most = jump, [], 1 + math.ceil(math.log2(max(2, nodes.count())))
    done = jump.filter("anc is null")
    while len(jumps) < most and jump.filter("anc is not null").limit(1).count():
        # only messages that don't see their root yet are joined on; those that do are only looked up
        jump = jump.filter("anc is not null")
        jumps.append(jump.select(F.col("t").alias("jt"), F.col("n").alias("jn"), "anc"))
        on = jump.unionAll(done).select(F.col("t").alias("ot"), F.col("n").alias("on"), F.col("anc").alias("over"), F.col("hops").alias("more"), F.col("total").alias("sum"))
        met = jump.join(on, jump.t.eqNullSafe(F.col("ot")) & (jump.anc == F.col("on")))
        jump = staged(met.select("t", "n", F.col("over").alias("anc"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("total") + F.col("sum")).alias("total")), "chat-jumps")
        done = done.unionAll(jump.filter("anc is null"))
    inner = first.filter("anc is not null").select(F.col("t").alias("it"), F.col("anc").alias("inner")).distinct()
    leaves = done.join(inner, done.t.eqNullSafe(F.col("it")) & (done.n == F.col("inner")), "left_anti")
    best = Window.partitionBy("t").orderBy(F.col("total").desc(), F.col("hops").desc(), "n")
    paths = leaves.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= branches).select("t", F.col("n").alias("leaf"), "n", F.col("hops").alias("depth"))
    for level in reversed(range(len(jumps))):
        j = jumps[level]
        paths = staged(paths, "chat-paths")
        up = paths.join(j, paths.t.eqNullSafe(j.jt) & (paths.n == j.jn)).select("t", "leaf", F.col("anc").alias("n"), (F.col("depth") - (1 << level)).alias("depth"))
        paths = paths.unionAll(up)
    return paths


def format_paths(messages: DataFrame, tree_col: str, id_col: str, parent_col: str, role_col: str = "role", text_col: str = "text", score_col: str | None = None, branches: int = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """tree, leaf, n_turns, formatted, loss_spans: one conversation for each chosen path."""
    score = F.col(score_col) if score_col else F.lit(0.0)
    rows = messages.select(F.col(tree_col).alias("t"), F.col(id_col).alias("n"), F.struct(F.col(parent_col).alias("p"), score.cast("double").alias("s"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("m"))
    rows = staged(rows.groupBy("t", "n").agg(F.min("m").alias("m")).select("t", "n", "m.*"), "chat-messages")
    paths = chosen_paths(rows.select("t", "n", "p", "s"), branches).select(F.col("t").alias("pt"), "leaf", F.col("n").alias("pn"), "depth")
    text = escaped(F.col("text"))
    prefix = F.concat(F.lit(START), escaped(F.replace(F.replace("role", F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))), F.lit("\n"))
    turns = rows.join(paths, _same(rows, paths, ("t", "pt"), ("n", "pn"))).select("t", "leaf", "depth", "role", prefix.alias("prefix"), text.alias("body"))
    turns = turns.withColumn("piece", F.concat("prefix", "body", F.lit(END)))
    before = Window.partitionBy("t", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("prefix"))
    span = F.when(F.col("role").isin(*loss_roles), F.struct(F.col("at").alias("start"), F.char_length("body").cast("long").alias("length")))
    whole = turns.groupBy("t", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "piece", span.alias("span")))).alias("all"))
    return whole.select(
        F.col("t").alias("tree"), "leaf", F.size("all").cast("long").alias("n_turns"),
        F.array_join(F.col("all.piece"), "").alias("formatted"),
        F.filter(F.col("all.span"), lambda x: x.isNotNull()).alias("loss_spans"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns, array of (role, text), read back from a formatted conversation."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    bare = lambda x: F.substring(x, F.lit(len(START) + 1), F.char_length(x))
    role = lambda x: F.substring_index(bare(x), "\n", 1)
    plain = lambda x: F.replace(F.replace(unescaped(role(x)), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    text = lambda x: unescaped(F.substring(bare(x), F.char_length(role(x)) + 2, F.char_length(x)))
    return F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda x: F.struct(plain(x).alias("role"), text(x).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chains(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as trees: tree, id, parent, role, text. Turns are ordered by number, role and text, nulls first."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("id", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text")


#: DuckDB, for the query.
SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT *, '<|im_start|>' || regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g') || chr(10)
    || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10) AS piece FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(piece))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
