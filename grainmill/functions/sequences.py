"""Token sequences as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import let

#: Fixed value: a label the loss skips.
IGNORE = -100


def first_true(flags: Column) -> Column:
    """0-based place of the first true flag, the length if there is none."""
    at = F.array_position(flags, F.lit(True))
    return F.coalesce(F.nullif(at, F.lit(0)) - 1, F.size(flags)).cast("int")


def truncate(values: Column, n: int) -> Column:
    return F.slice(values, 1, n)


def last(values: Column, n: int) -> Column:
    return F.when(F.size(values) > n, F.slice(values, -n, n)).otherwise(values)


def after_stop(values: Column, stop: int) -> Column:
    """Up to and with the first stop token."""
    at = F.array_position(values, F.lit(stop))
    return F.when(at > 0, F.slice(values, F.lit(1), at.cast("int"))).otherwise(values)


def pad_after_stop(values: Column, stop: int, pad: int) -> Column:
    return let(F.array_position(values, F.lit(stop)), lambda at: F.transform(values, lambda x, i: F.when((at > 0) & (i >= at), F.lit(pad)).otherwise(x)))


def with_bos(values: Column, bos: int) -> Column:
    return F.when(F.get(values, F.lit(0)).eqNullSafe(F.lit(bos)), values).otherwise(F.concat(F.array(F.lit(bos)), values))


def with_eos_token(values: Column, eos: int) -> Column:
    has = (F.size(values) > 0) & (F.get(values, F.greatest(F.size(values) - 1, F.lit(0))) == eos)
    return F.when(has, values).otherwise(F.concat(values, F.array(F.lit(eos))))


def padded(values: Column, to: Column, pad: int, side: str = "right") -> Column:
    """Filled up to a length; longer ones stay."""
    fill = F.array_repeat(F.lit(pad), F.greatest(to - F.size(values), F.lit(0)).cast("int"))
    return F.concat(values, fill) if side == "right" else F.concat(fill, values)


def round_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("int")


def completion_mask(prompt: Column, completion: Column) -> Column:
    """0 for each prompt token, 1 for each completion token."""
    return F.concat(F.array_repeat(F.lit(0), F.size(prompt)), F.array_repeat(F.lit(1), F.size(completion)))


def labels(values: Column, mask: Column) -> Column:
    return F.zip_with(values, mask, lambda x, m: F.when(m == 1, x).otherwise(F.lit(IGNORE)))


def position_ids(lengths: Column) -> Column:
    """Positions that begin again at 0 in each packed sequence."""
    runs = F.transform(F.filter(lengths, lambda n: n > 0), lambda n: F.sequence(F.lit(0), n - 1))
    return F.flatten(runs)


def flushed(values: Column, mask: Column, side: str = "left", pad: int = 0) -> Column:
    """Tokens with mask 1 moved to one side, the rest filled."""
    kept = F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    return padded(kept, F.size(values), pad, "right" if side == "left" else "left")


def shifted_right(values: Column, start: int) -> Column:
    return F.concat(F.array(F.lit(start)), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))))


def protected_truncate(values: Column, protected: list[int], n: int) -> Column:
    """To n tokens: all protected ones and the rightmost others, in order; an error if the protected alone are more."""
    keep = F.array(*[F.lit(p) for p in protected])
    guarded = lambda x: F.array_contains(keep, x)
    room = F.lit(n) - F.size(F.filter(values, guarded))
    loose = F.filter(F.transform(values, lambda x, i: F.when(~guarded(x), i)), lambda i: i.isNotNull())
    first = let(loose, lambda o: F.coalesce(F.get(o, F.size(o) - room), F.lit(1 << 30)))  # from here on all others are kept
    out = let(first, lambda start: F.filter(values, lambda x, i: guarded(x) | (i >= start)))
    return F.when(F.size(values) <= n, values).when(room < 0, F.raise_error(F.lit("protected tokens exceed the length")).cast("array<int>")).otherwise(out)


def preference_row(prompt: Column, chosen: Column, rejected: Column, eos: int, max_prompt: int, max_completion: int) -> Column:
    """struct(prompt, chosen, rejected): the prompt's last tokens, the completions' first ones with an end token."""
    full = lambda c: F.concat(c, F.array(F.lit(eos)))
    return F.struct(last(prompt, max_prompt).alias("prompt"), truncate(full(chosen), max_completion).alias("chosen"), truncate(full(rejected), max_completion).alias("rejected"))


def answer_row(prompt: Column, answer: Column, max_length: int, max_prompt: int, mode: str = "keep_end") -> Column:
    """struct(input_ids, labels): the prompt shortened first if both are too long, then the answer; prompt labels ignored."""
    long = F.size(prompt) + F.size(answer) > max_length
    short = last(prompt, max_prompt) if mode == "keep_end" else truncate(prompt, max_prompt)
    p = F.when(long, short).otherwise(prompt)
    a = F.slice(answer, F.lit(1), F.greatest(F.lit(max_length) - F.size(p), F.lit(0)))
    return F.struct(F.concat(p, a).alias("input_ids"), F.concat(F.array_repeat(F.lit(IGNORE), F.size(p)), a).alias("labels"))


def split_answer(prompt: Column, whole: Column) -> Column:
    """struct(prompt, answer) of a whole's tokens, given its prompt's: where a tokenizer merges the prompt's last token with
    the answer's first, the prompt ends one token earlier."""
    n = F.size(prompt)
    merged = ~F.slice(whole, F.lit(1), n).eqNullSafe(prompt)
    at = F.when(merged & (n > 0), n - 1).otherwise(n)
    return F.struct(F.slice(whole, F.lit(1), at).alias("prompt"), F.slice(whole, at + 1, F.greatest(F.size(whole), F.lit(1))).alias("answer"))


def stepwise_row(prompt: Column, steps: Column, flags: Column, separator: int, last_only: bool = False) -> Column:
    """struct(input_ids, labels) of supervised steps: each step ends with a separator that carries its label."""
    n = F.size(steps)
    ids = F.flatten(F.transform(steps, lambda s: F.concat(s, F.array(F.lit(separator)))))
    mark = lambda f, i: F.when(F.lit(not last_only) | (i == n - 1), f.cast("int")).otherwise(F.lit(IGNORE))
    marks = F.flatten(F.zip_with(steps, F.transform(flags, mark), lambda s, f: F.concat(F.array_repeat(F.lit(IGNORE), F.size(s)), F.array(f))))
    return F.struct(F.concat(prompt, ids).alias("input_ids"), F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt)), marks).alias("labels"))


def gae(rewards: Column, values: Column, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """Generalised advantages of one episode, the value after its end taken as 0."""
    after = F.concat(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.array(F.lit(0.0)))
    delta = F.zip_with(F.zip_with(rewards, after, lambda r, v: r + gamma * v), values, lambda x, v: x - v)
    start = F.expr("cast(array() as array<double>)")
    back = F.aggregate(F.reverse(delta), start, lambda acc, d: F.concat(F.array(d + gamma * lam * F.coalesce(F.get(acc, F.lit(0)), F.lit(0.0))), acc))
    return back


#: Fixed value: the placeholder of a picture among token ids.
IMAGE = -200


def image_splice(chunks: Column, bos: int | None = None) -> Column:
    """Token ids of a prompt's pieces (array of arrays), one placeholder between each two; a leading start token that every
    piece has is kept once."""
    bare = chunks if bos is None else F.transform(chunks, lambda c: F.when(F.get(c, F.lit(0)).eqNullSafe(F.lit(bos)), F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))).otherwise(c))
    joined = F.flatten(F.transform(bare, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.array(F.lit(IMAGE)), c))))
    first = F.get(F.get(chunks, F.lit(0)), F.lit(0))
    return joined if bos is None else F.when(first.eqNullSafe(F.lit(bos)), F.concat(F.array(F.lit(bos)), joined)).otherwise(joined)


def dialogue_split(values: Column, spans: Column) -> Column:
    """struct(query, response, mask) of a history's tokens: spans (array of struct<length, generated>) in order; the first is
    the query, the mask marks what the model wrote among the rest."""
    q = F.get(spans, F.lit(0))["length"]
    rest = F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1)))
    mask = F.flatten(F.transform(rest, lambda s: F.array_repeat(s["generated"].cast("int"), s["length"])))
    return F.struct(F.slice(values, F.lit(1), q).alias("query"), F.slice(values, q + 1, F.greatest(F.size(values), F.lit(1))).alias("response"), mask.alias("mask"))
