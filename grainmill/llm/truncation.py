"""Texts that lost their end: hidden storage limits of a source, and what a text's end looks like.

A field that cuts at a fixed size leaves a spike in the lengths of its texts, but only in the measure the field counts in:
characters, bytes, UTF-16 units, words, or the length after entity escaping, JSON escaping or newline conversion. Lengths
are recomputed in all of them and counted per source; a spike names measure and limit. A text at its source's limit is cut
if it doesn't end a sentence. Elsewhere the end alone must show it: a broken character, entity, tag or escape, a marker of
a cut, an open structure, or a sentence in ordinary style that just stops.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..context import listed

#: A limit needs so many texts at it, and so many times the texts that lengths nearby have.
LEAST_AT_LIMIT, SPIKE = 10, 6.0
#: A byte limit ends up to three bytes early where a character didn't fit.
SLACK = 3


def _times(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def lengths(text: Column) -> dict[str, Column]:
    """The measures. In order: of two measures that fit equally well the first is taken."""
    quotes, slashes, lines = _times(text, '"'), _times(text, "\\"), _times(text, "\n")
    bare = lines - (F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("")))) / 2
    entities = 4 * _times(text, "&") + 3 * _times(text, "<") + 3 * _times(text, ">") + 5 * quotes + 5 * _times(text, "'")
    escapes = quotes + slashes + lines + _times(text, "\t") + _times(text, "\r")
    return {
        "characters": F.length(text),
        "utf8": F.octet_length(text),
        "utf16": F.octet_length(F.encode(text, "UTF-16LE")) / 2,
        "words": F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))),
        "entities": F.length(text) + entities,
        "entities_utf8": F.octet_length(text) + entities,
        "json": F.length(text) + escapes,
        "json_utf8": F.octet_length(text) + escapes,
        "crlf": F.length(text) + bare,
        "crlf_utf8": F.octet_length(text) + bare,
    }


def _independent(table: pa.Table) -> pa.Table:
    """The spikes of one source that explain texts of their own: the one with most texts, then the one with most of the
    texts that are left, as long as these alone still are a spike."""
    left = [(r["n"], {(s["measure"], s["limit"]): s for s in r["at"]}) for r in table.to_pylist()]
    kept = []
    while True:
        exact, counted, facts = Counter(), Counter(), {}
        for n, at in left:
            for k, s in at.items():
                exact[k] += n if s["short"] == 0 else 0
                counted[k] += n if s["short"] <= s["early"] else 0
                facts[k] = s
        spikes = [(counted[k], -facts[k]["rank"], *k) for k, n in exact.items() if n >= max(LEAST_AT_LIMIT, SPIKE * facts[k]["around"])]
        if not spikes:
            break
        texts, _, *best = max(spikes)
        kept.append((*best, texts))
        left = [(n, at) for n, at in left if tuple(best) not in at]
    columns = [pa.array([x[k] for x in kept], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
    return pa.Table.from_arrays([pa.array([table.column("source")[0].as_py()] * len(kept), pa.string()), *columns], names=["source", "measure", "limit", "at_limit"])


def _slack(measure: Column) -> Column:
    return F.when(measure.endswith("utf8"), F.lit(SLACK)).otherwise(F.lit(0))


def storage_limits(texts: DataFrame, source: str, text: str) -> DataFrame:
    """(source, measure, limit, at_limit): every independent spike of a source, with its number of distinct texts.

    A spike is a length shared by LEAST_AT_LIMIT distinct texts, by SPIKE times as many as a length within 40 on either side
    has on average. Copies count once, so that a repeated text is no limit. Of measures that explain the same texts the one
    with most texts is kept; what the others hold beyond these must be a spike in itself. Counting combines on the map side;
    what the window sees is one row per distinct length.
    """
    named = lengths(F.col(text))
    measured = texts.where(F.col(text).isNotNull()).select(
        F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("hash"), *[c.cast("long").alias(k) for k, c in named.items()]
    ).distinct()
    measures = F.create_map(*[x for k in named for x in (F.lit(k), F.col(k))])
    counts = measured.select("source", F.explode(measures).alias("measure", "length")).groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"))
    near = W.partitionBy("source", "measure").orderBy("length")
    around = [
        F.coalesce(F.sum("n").over(near.rangeBetween(lo, hi)), F.lit(0)) / (hi - lo + 1) for lo, hi in ((-40, -SLACK - 1), (SLACK + 1, 40), (-12, -2), (2, 12))
    ]
    spiked = (
        counts.where("length >= 24")
        .withColumn("wide", F.greatest(around[0], around[1]))
        .withColumn("tight", F.greatest(around[2], around[3]))
        .withColumn("below", F.sum("n").over(near.rangeBetween(-SLACK, 0)))
        .withColumn("around", F.when(F.col("measure") == "words", F.col("tight")).otherwise(F.col("wide")))
        .where((F.col("n") >= LEAST_AT_LIMIT) & (F.col("n") >= SPIKE * F.col("around")))
    )
    rank = F.create_map(*[x for i, k in enumerate(named) for x in (F.lit(k), F.lit(i))])[F.col("measure")]
    # a byte limit is told from a character limit by the texts just below it, if they are more than chance puts there
    early = F.col("below") - F.col("n") - SLACK * F.col("wide")
    cut_early = F.col("measure").endswith("utf8") & (early > F.greatest(F.lit(3.0), 0.1 * F.col("n")))
    spike = F.struct("measure", F.col("length").alias("limit"), rank.alias("rank"), "around", F.when(cut_early, F.lit(SLACK)).otherwise(F.lit(0)).alias("early"))
    spikes = listed(spiked.groupBy(F.col("source").alias("spiked")).agg(F.sort_array(F.collect_list(spike)).alias("spikes")))
    short = lambda s: s["limit"] - F.element_at(measures, s["measure"])
    reached = F.filter("spikes", lambda s: short(s).between(F.lit(0), _slack(s["measure"])))
    at = measured.join(spikes, F.col("source").eqNullSafe(F.col("spiked"))).select("source", F.transform(reached, lambda s: s.withField("short", short(s))).alias("at"))
    sets = at.where(F.size("at") > 0).groupBy("source", "at").agg(F.count(F.lit(1)).alias("n"))
    return sets.groupBy("source").applyInArrow(_independent, "source string, measure string, limit long, at_limit long")


_BROKEN = re.compile(r"(?:&#?[A-Za-z0-9]{0,7}|</?[A-Za-z][^<>\n]{0,40}|<|\\|\\u[0-9a-fA-F]{0,3}|%[0-9A-Fa-f]?|[�\ud800-\udfff]+)$")
_MARKER = re.compile(r"(?i)(?:[\[(<]\s*(?:\.\.\.|…|more|truncated|cut|cont(?:inued|\.)?|read (?:on|more))[^\])>]{0,20}[\])>]|(?:\.\.\.|…)\s*(?:\(?\s*(?:read|see|show|view)?\s*(?:on|more|all)\s*\)?))$")
_ELLIPSIS = re.compile(r"(?:\.\.\.|…)$")
_END = re.compile(r"[.!?…。！？][\"'”’»)\]*_]*$")
#: A full stop that changed places with the last letter is still a full stop.
_SWAPPED = re.compile(r"[.!?]\w$")
_NUMBER = re.compile(r"(?:^|\s)\d+\.$")
_URL = re.compile(r"(?:https?://|www\.)\S+$")
_ITEM = re.compile(r"\s*(?:[-*•+]|\d+[.)])\s+\S")


def _open_structure(text: str) -> bool:
    """An unclosed code fence, think or answer block, or JSON value."""
    if text.count("```") % 2:
        return True
    for name in ("think", "answer"):
        if text.count(f"<{name}>") > text.count(f"</{name}>"):
            return True
    if text[0] in "{[" and text[1:2] in '"{[':
        try:
            json.loads(text)
        except ValueError as e:
            return "Expecting" not in str(e) or e.pos >= len(text) - 1 or not text.endswith(("}", "]"))
    return False


def _signed(lines: list[str]) -> bool:
    """A closing formula and a name below a finished sentence, or a name after a dash."""
    short = 0
    while short < min(2, len(lines) - 1) and len(lines[-1 - short].split()) <= 3:
        short += 1
    if short == 0 or short == 1 and lines[-1].lstrip()[0] not in "-\u2013\u2014":
        return False
    before = lines[-1 - short]
    return bool(_END.search(before) or _URL.search(before) or _ITEM.match(before))


def ending(text: str | None) -> str:
    """What the end of a text shows: broken, marker, open (all of a cut), ellipsis, stops (a sentence that just stops),
    number, whole, or loose: no full stop, but in a style that uses none. Null and blank texts are whole."""
    t = (text or "").rstrip()
    if not t:
        return "whole"
    if _BROKEN.search(t):
        return "broken"
    if _MARKER.search(t):
        return "marker"
    if _open_structure(t):
        return "open"
    if _ELLIPSIS.search(t):
        return "ellipsis"
    if _NUMBER.search(t):
        return "number"
    if _END.search(t) or _SWAPPED.search(t) or t.endswith(("```", "}", "</think>", "</answer>")):
        return "whole"
    lines = [x for x in t.split("\n") if x.strip()]
    styled = t != t.lower() and t != t.upper()  # a style with capitals; captions and hasty typing have none or only them
    if not styled or _URL.search(t) or _ITEM.match(lines[-1]) or _signed(lines) or len(t.split()) < 6:
        return "loose"
    return "stops"


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [(ending(t), len((t or "").split())) for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([e for e, _ in ends], pa.string()), pa.array([n for _, n in ends], pa.int32())], names=["id", "source", "measures", "ending", "n_words"])


def truncated(texts: DataFrame, id_column: str, source: str, text: str) -> DataFrame:
    """(id, source, measure, limit, at_limit, ending, truncated) of every row with an id and a text.

    measure and limit are those of the limit a text is at, else those of the limit of its source with most texts.
    Null sources form a group of their own, which has its own limits. Null texts have nothing that could be cut and give no
    row. At a limit any end that isn't whole counts; elsewhere a cut end (broken, marker, open, stops), or an ellipsis
    after at least twelve words.
    """
    rows = texts.where(F.col(id_column).isNotNull() & F.col(text).isNotNull())
    limits = storage_limits(rows, source, text)
    measures = F.create_map(*[x for k, c in lengths(F.col(text)).items() for x in (F.lit(k), c.cast("long"))])
    seen = rows.select(F.col(id_column).cast("long").alias("id"), F.col(source).alias("source"), measures.alias("measures"), F.col(text).alias("text")).mapInArrow(
        _endings, "id long, source string, measures map<string,bigint>, ending string, n_words int"
    )
    limit = F.struct((-F.col("at_limit")).alias("order"), "measure", "limit")
    limits = listed(limits.groupBy(F.col("source").alias("limited")).agg(F.sort_array(F.collect_list(limit)).alias("limits")))
    joined = seen.join(limits, F.col("source").eqNullSafe(F.col("limited")), "left")
    reached = F.filter("limits", lambda x: F.element_at("measures", x["measure"]).between(x["limit"] - _slack(x["measure"]), x["limit"]))
    shown = F.coalesce(F.get(reached, F.lit(0)), F.get("limits", F.lit(0)))
    joined = joined.withColumn("shown", shown).withColumns({"measure": F.col("shown.measure"), "limit": F.col("shown.limit")})
    at = F.coalesce(F.size(reached) > 0, F.lit(False))
    shows = F.col("ending").isin("broken", "marker", "open", "stops") | ((F.col("ending") == "ellipsis") & (F.col("n_words") >= 12))
    return joined.withColumn("at_limit", at).select(
        "id", "source", "measure", "limit", "at_limit", "ending", ((F.col("at_limit") & (F.col("ending") != "whole")) | shows).alias("truncated")
    )


def truncation_rates(found: DataFrame) -> DataFrame:
    """(source, texts, cut, rate, measure, limit) of the rows of truncated(); of several limits the one most rows show."""
    parts = found.groupBy("source", "measure", "limit").agg(F.count(F.lit(1)).alias("n"), F.count_if("truncated").alias("c"))
    return parts.groupBy("source").agg(
        F.sum("n").alias("texts"), F.sum("c").alias("cut"), F.round(F.sum("c") / F.sum("n"), 6).alias("rate"), F.max_by("measure", "n").alias("measure"), F.max_by("limit", "n").alias("limit")
    )
