"""Chat formatting over reply trees (DataFrame functions only).

A message names its parent. Root-to-leaf paths are found by iterative self-joins that double the
stride each round (every message knows its 1st, 2nd, 4th, ... ancestor), so a thread of n messages
takes log2(n) joins of n short rows and no path is carried along. Leaves are ranked within their
conversation by the mean score of their path, the chosen leaves are walked back up with the same
strides, and each chosen path is formatted as one conversation.

Template: every turn is `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts, control strings
(these and those of another common template) are escaped reversibly: a backslash becomes `\\s`, and
`<` or `[` where a control string begins becomes `\\l` or `\\b`; in roles a newline becomes `\\n`. Each turn's
text span in the output (code points) carries whether it is under the loss mask.

Cases: null roles and texts count as empty; rows without turn come last in their conversation, equal
turns are ordered by role and text and repeated rows are turns of their own; a null conversation id
is a conversation; a parent that does not exist makes a root; no messages give no rows; ids may be of any type; other columns,
whatever their names, are ignored. A formatted conversation is one string, as the format demands; its turns' offsets are running sums in
log-many steps, so a conversation of n turns takes n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm._shared import cut, running, stored

#: The template's marks, and where the control strings of templates begin.
START, END = "<|im_start|>", "<|im_end|>\n"
_ANGLE = r"<(?=\|im_start\||\|im_end\||/?s>|<SYS>>|</SYS>>)"
_SQUARE = r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\s"))
    text = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, _ANGLE, r"\\l")).otherwise(text)
    return F.when(F.contains(text, F.lit("[")), F.regexp_replace(text, _SQUARE, r"\\b")).otherwise(text)


def unescape(text: Column) -> Column:
    for code, plain in (("\\n", "\n"), ("\\l", "<"), ("\\b", "["), ("\\s", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def chains(messages: DataFrame) -> DataFrame:
    """Turns of linear conversations as a reply tree: each answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return messages.select("conv_id", F.row_number().over(order).alias("node"), role.alias("role"), text.alias("text")).select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def _key(conv: Column, node: Column) -> Column:
    """A message's id over all conversations; both parts are compared as they are, null ones too."""
    return F.struct(conv.alias("conv"), node.alias("node"))


def best_paths(tree: DataFrame, top: int = 1) -> DataFrame:
    """(conv_id, node, parent, score) -> rows (conv_id, branch, depth, node) of the `top` best root-to-leaf paths.

    A path's rank is its mean score; ties go to the longer, then to the smaller leaf. Messages on a
    cycle have no root and are on no path.
    """
    parent = F.col("parent").cast(tree.schema["node"].dataType)
    me = tree.select("conv_id", _key(F.col("conv_id"), F.col("node")).alias("id"), "node", _key(F.col("conv_id"), parent).alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"), F.col("parent").isNotNull().alias("has"))
    known = me.select(F.col("id").alias("up"))
    up = F.when(F.col("has"), F.col("up"))
    step = cut(me.select("conv_id", "id", "node", up.alias("up"), "total").join(known.withColumn("there", F.lit(True)), "up", "left").select("conv_id", "id", "node", F.when(F.col("there"), F.col("up")).alias("up"), "total", F.lit(1).cast("long").alias("depth")))
    inner = step.where("up is not null").select(F.col("up").alias("id")).distinct()
    leaves = step.join(inner, "id", "left_anti").select("id")
    strides = []
    most = step.count()
    reach = 1
    while True:
        climbing = step.where("up is not null")
        strides.append(climbing.select("id", "up"))
        if not climbing.limit(1).count() or reach > 2 * most:
            break
        # only messages that have not reached their root yet are joined
        above = step.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("further"))
        higher = climbing.join(above, "up").select("conv_id", "id", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("further")).alias("depth"))
        step = cut(step.where("up is null").unionByName(higher))
        reach *= 2
    ranked = Window.partitionBy("conv_id").orderBy((F.col("total") / F.col("depth")).desc(), F.col("depth").desc(), "node")
    ends = step.where("up is null").join(leaves, "id").withColumn("branch", F.row_number().over(ranked)).where(F.col("branch") <= top)
    on = cut(ends.select("branch", F.col("id").alias("leaf"), "id"))
    for stride in reversed(strides[:-1]):
        on = cut(on.unionByName(on.join(stride, "id").select("branch", "leaf", F.col("up").alias("id"))))
    return on.join(step.select("id", "conv_id", "node", "depth"), "id").select("conv_id", "branch", "depth", "node")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escape(text), F.lit(END))


def _spans(size: Column, inside: Column) -> Column:
    """(begin, end) of each turn's text in the whole string, from the turns' lengths and the lengths of their texts."""
    return F.zip_with(running(size), inside, lambda end, n: F.struct((end - len(END) - n).alias("begin"), (end - len(END)).alias("end")))


def formatted(tree: DataFrame, top: int = 1, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per chosen path: conv_id, branch, formatted, and turns (begin, end of its text; learn: under the loss mask)."""
    tree = stored(tree)
    paths = best_paths(tree.select("conv_id", "node", "parent", "score"), top)
    texts = tree.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = paths.join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    said = F.struct("depth", _turn(F.col("role"), F.col("text")).alias("said"), F.length(escape(F.col("text"))).cast("long").alias("inside"), F.col("role").isin(*learn_from).alias("learn"))
    turns = rows.groupBy("conv_id", "branch").agg(F.sort_array(F.collect_list(said)).alias("t"))
    size, inside = F.transform("t", lambda x: F.length(x.said).cast("long")), F.transform("t", lambda x: x.inside)
    spans = F.zip_with(_spans(size, inside), F.col("t"), lambda s, x: F.struct(s.begin.alias("begin"), s.end.alias("end"), x.learn.alias("learn")))
    return turns.select("conv_id", "branch", F.array_join(F.transform("t", lambda x: x.said), "").alias("formatted"), spans.alias("turns"))


def read_back(formatted_rows: DataFrame) -> DataFrame:
    """Parses the output: conv_id, branch, turns (role, text) and learnt, the texts under the loss mask, all unescaped.

    A turn's text counts as learnt only if its span in the string is a masked one.
    """
    pieces = F.transform(F.slice(F.split("formatted", r"<\|im_end\|>\n", -1), 1, F.size("turns")), lambda p: F.substr(p, F.lit(len(START) + 1)))
    split = F.transform(pieces, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("role"), F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2).alias("text")))
    rows = formatted_rows.withColumn("said", split)
    size = F.transform("said", lambda x: (F.length(x.role) + F.length(x.text) + len(START) + 1 + len(END)).cast("long"))
    rows = rows.withColumn("spans", _spans(size, F.transform("said", lambda x: F.length(x.text).cast("long"))))
    learnt = F.filter(F.arrays_zip("said", "spans", "turns"), lambda x: x.turns.learn & (x.turns.begin == x.spans.begin) & (x.turns.end == x.spans.end))
    return rows.select(
        "conv_id", "branch", "formatted",
        F.transform("said", lambda x: F.struct(unescape(x.role).alias("role"), unescape(x.text).alias("text"))).alias("turns"),
        F.transform(learnt, lambda x: unescape(x.said.text)).alias("learnt"),
    )


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of what was read back."""
    loss = F.array_join("learnt", "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
