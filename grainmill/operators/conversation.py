"""Dataset shapes: conversations, prompts, preference pairs. Dispatch is by schema, never by looking at rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def is_conversational(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and {"role", "content"} <= set(kind.elementType.names)


def is_from_value(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and {"from", "value"} <= set(kind.elementType.names)


#: The column sets of the dataset types.
SHAPES = {
    "language modelling": [{"messages"}, {"text"}],
    "prompt only": [{"prompt"}],
    "prompt completion": [{"prompt", "completion"}],
    "preference": [{"prompt", "chosen", "rejected"}],
    "implicit preference": [{"chosen", "rejected"}],
    "unpaired preference": [{"prompt", "completion", "label"}],
    "stepwise": [{"prompt", "completions", "labels"}],
}


def shape(df: DataFrame) -> str:
    known = set().union(*(s for sets in SHAPES.values() for s in sets))
    have = set(df.columns) & known
    for name, sets in SHAPES.items():
        if have in sets:
            return name
    raise ValueError(f"no dataset type has the columns {sorted(have)}")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): turns in order of (turn_idx, message_id), null contents kept. A conversation is one row by
    nature; its turns are gathered on the map side first."""
    item = F.struct("turn_idx", "message_id", "role", "content")
    gathered = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("t"))
    return gathered.select("conv_id", F.transform("t", lambda x: X.turn(x["role"], x["content"])).alias("messages"))


def to_chatml(df: DataFrame) -> DataFrame:
    """from/value lists become role/content; a column `conversations` is then called messages."""
    for f in df.schema.fields:
        if is_from_value(f.dataType):
            df = df.withColumn(f.name, X.to_chatml(F.col(f.name)))
    return df.withColumnRenamed("conversations", "messages") if "conversations" in df.columns else df


def shared_prompt_length(chosen: Column, rejected: Column) -> Column:
    """Leading turns that both sides have; if one side is a prefix of the other, all but its last turn. Null sides have
    none."""
    n = F.least(F.size(chosen), F.size(rejected))
    differs = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ~F.get(chosen, i).eqNullSafe(F.get(rejected, i)))
    return F.when(chosen.isNull() | rejected.isNull() | (n <= 0), 0).otherwise(F.coalesce(F.get(differs, F.lit(0)), n - 1)).cast("int")


def extract_prompt(pairs: DataFrame) -> DataFrame:
    """Turns that chosen and rejected begin with become the prompt, and leave both sides."""
    n = F.col("_shared")  # a column of its own: the lambda inside must not be evaluated in three places
    rest = lambda c: F.slice(F.col(c), n + 1, F.greatest(F.size(c), F.lit(1)))
    known = pairs.withColumn("_shared", shared_prompt_length(F.col("chosen"), F.col("rejected")))
    return known.withColumns({"prompt": F.slice("chosen", F.lit(1), n), "chosen": rest("chosen"), "rejected": rest("rejected")}).drop("_shared")


def extract_text_prompt(pairs: DataFrame) -> DataFrame:
    """The beginning that two texts share becomes the prompt and leaves both: up to where they differ, or to the last
    character of the shorter one if that is all of it, and without a space at its end. Null sides share nothing."""
    shared, n = F.length(X.common_prefix(F.col("chosen"), F.col("rejected"))), F.least(F.length("chosen"), F.length("rejected"))
    known = pairs.withColumn("_n", F.when(shared.isNotNull(), F.least(shared, F.greatest(n - 1, F.lit(0)))).otherwise(0))
    known = known.withColumn("_n", F.when((F.col("_n") > 0) & (F.substr("chosen", F.col("_n"), F.lit(1)) == " "), F.col("_n") - 1).otherwise(F.col("_n")))
    rest = lambda c: F.substr(F.col(c), F.col("_n") + 1)
    return known.withColumns({"prompt": F.substr(F.coalesce("chosen", F.lit("")), F.lit(1), F.col("_n")), "chosen": rest("chosen"), "rejected": rest("rejected")}).drop("_n")


def maybe_extract_prompt(pairs: DataFrame) -> DataFrame:
    """Only where there is no prompt yet, or it isn't conversational while the sides are."""
    sides = is_conversational(pairs.schema["chosen"].dataType)
    if "prompt" in pairs.columns and is_conversational(pairs.schema["prompt"].dataType) == sides:
        return pairs
    return extract_prompt(pairs) if sides else extract_text_prompt(pairs)


def unpair(pairs: DataFrame) -> DataFrame:
    """(..., completion, label): each pair as a wanted row and an unwanted one. Null sides stay rows."""
    others = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    return pairs.select(*others, F.explode(F.array(F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")), F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label")))).alias("_p")).select(*others, "_p.completion", "_p.label")


def apply_template(df: DataFrame) -> DataFrame:
    """Conversational columns as text: messages become `text`; a prompt asks for its answer, and a completion is what the
    whole rendered conversation adds to it."""
    out = df
    if "messages" in df.columns and is_conversational(df.schema["messages"].dataType):
        return df.withColumn("text", X.render(F.col("messages"))).drop("messages")
    if "prompt" in df.columns and is_conversational(df.schema["prompt"].dataType):
        prompt = X.with_generation_prompt(X.render(F.col("prompt")), F.col("prompt"))
        for c in ("chosen", "rejected", "completion"):
            if c in df.columns and is_conversational(df.schema[c].dataType):
                whole = X.render(F.concat(F.col("prompt"), F.col(c)))
                out = out.withColumn(c, F.substr(whole, F.length(prompt) + 1, F.greatest(F.length(whole) - F.length(prompt), F.lit(0))))
        out = out.withColumn("prompt", prompt)
    return out


def within_length(df: DataFrame, limit: int, *columns: str) -> DataFrame:
    """Rows whose texts together are no longer than the limit; a null text makes no row long."""
    return df.where(sum((F.coalesce(F.length(F.col(c)), F.lit(0)) for c in columns), F.lit(0)) <= limit)


def ring_shift(rows: DataFrame, batch: str, order: str, column: str, name: str) -> DataFrame:
    """In each batch the column of the row before; the first row has the last one's. Batches are of bounded size."""
    from pyspark.sql import Window as W

    w = W.partitionBy(batch).orderBy(order)
    n = F.row_number().over(w)
    whole = W.partitionBy(batch).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.withColumn(name, F.when(n == 1, F.last(column).over(whole)).otherwise(F.lag(column).over(w)))


# Converters of public dataset layouts into the canonical shapes.


def from_transcripts(df: DataFrame) -> DataFrame:
    """chosen and rejected transcripts: the common beginning is the prompt, each rest a completion."""
    turns = df.withColumns({"chosen": X.dialogue_turns(F.col("chosen")), "rejected": X.dialogue_turns(F.col("rejected"))})
    return extract_prompt(turns)


def from_posts(df: DataFrame) -> DataFrame:
    """subreddit, title, post, summary: a TL;DR prompt and its completion."""
    prompt = F.concat(F.lit("SUBREDDIT: r/"), "subreddit", F.lit("\n\nTITLE: "), "title", F.lit("\n\nPOST: "), "post", F.lit("\n\nTL;DR:"))
    return df.select(prompt.alias("prompt"), F.concat(F.lit(" "), F.trim("summary")).alias("completion"))


def from_questions(df: DataFrame) -> DataFrame:
    """question, response_j, response_k: question-and-answer prompts."""
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\n\nAnswer: "))
    return df.select(prompt.alias("prompt"), F.col("response_j").alias("chosen"), F.col("response_k").alias("rejected"))


def from_ratings(df: DataFrame, model: str, threshold: int = 5) -> DataFrame:
    """instruction, models, completions array<struct<response, rating>>: one model's answer, wanted if rated high enough."""
    at = F.array_position("models", F.lit(model)).cast("int")
    mine = F.when(at > 0, F.element_at("completions", at))
    return df.where(F.array_contains("models", model)).select(F.col("instruction").alias("prompt"), mine["response"].alias("completion"), (mine["rating"].try_cast("int") >= threshold).alias("label"))


def from_four(df: DataFrame) -> DataFrame:
    """query, best, sample0..3: the best sample against the first that differs; rows whose samples are all equal go."""
    samples = [F.col(f"sample{i}") for i in range(4)]
    same = samples[0].eqNullSafe(samples[1]) & samples[0].eqNullSafe(samples[2]) & samples[0].eqNullSafe(samples[3])
    chosen = F.get(F.array(*samples), F.col("best"))
    other = lambda c: F.get(F.filter(F.array(*samples), lambda x: x != c), F.lit(0))
    return df.where(~same).select(F.col("query").alias("prompt"), chosen.alias("chosen"), other(chosen).alias("rejected"))


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def from_marked_steps(df: DataFrame, marker: str = "ки") -> DataFrame:
    """input with markers after each step and label with + or - in their places: prompt, completions, labels."""
    first = F.instr("input", "Step 1:")
    prompt = F.trim(F.when(first > 0, F.substr("input", F.lit(1), first - 1)).otherwise(F.col("input")))
    n = F.size(F.split(F.col("input"), marker)) - 1
    steps = F.transform(F.slice(F.split(F.when(first > 0, F.substr("input", first)).otherwise(F.lit("")), marker), F.lit(1), F.greatest(n, F.lit(0))), _strip)
    signs = F.transform(F.filter(F.split(F.when(first > 0, F.substr("label", first)).otherwise(F.lit("")), r"Step \d+: "), lambda s: s != ""), lambda s: F.endswith(_strip(s), F.lit("+")))
    return df.select(prompt.alias("prompt"), steps.alias("completions"), signs.alias("labels"))


def from_step_tree(df: DataFrame) -> DataFrame:
    """problem, steps array<struct<completions array<struct<text, rating>>, chosen int>>: a row for each rejected
    completion after the path so far, and one for the whole path; label is rating 1."""
    took = lambda s: F.get(s["completions"], F.coalesce(s["chosen"], F.lit(0)))
    path = F.transform("steps", took)
    rows = F.flatten(
        F.transform(
            "steps",
            lambda s, i: F.transform(
                F.filter(s["completions"], lambda c: ~c["text"].eqNullSafe(took(s)["text"])), lambda c: F.concat(F.slice(path, F.lit(1), i), F.array(c))
            ),
        )
    )
    alls = F.when(F.size("steps") > 0, F.concat(rows, F.array(path))).otherwise(rows)
    return df.select(F.col("problem").alias("prompt"), F.explode(alls).alias("p")).select("prompt", F.transform("p", lambda c: c["text"]).alias("completions"), F.transform("p", lambda c: c["rating"] == 1).alias("labels"))


def format_text(df: DataFrame) -> DataFrame:
    """Adds `formatted` by the schema: messages, or instruction (prompt) with completion. Another schema is an error."""
    if "messages" in df.columns and is_conversational(df.schema["messages"].dataType):
        return df.withColumn("formatted", X.render(F.col("messages")))
    if {"prompt", "completion"} <= set(df.columns):
        turns = F.array(X.turn("user", F.col("prompt")), X.turn("assistant", F.col("completion")))
        return df.withColumn("formatted", X.render(turns))
    raise ValueError(f"no formatting for the columns {df.columns}")


def flatten(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested structs as columns named by their path; a name that holds the separator is an error."""

    def walk(schema: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        out = []
        for f in schema.fields:
            if sep in f.name:
                raise ValueError(f"{f.name!r} holds {sep!r}")
            out += walk(f.dataType, (*path, f.name)) if isinstance(f.dataType, T.StructType) else [(*path, f.name)]
        return out

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in walk(df.schema, ())])
