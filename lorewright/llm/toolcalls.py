"""Tool calls linked to their results, ordered, checked and serialised.

Everything is a DataFrame operation.  A call is known by its conversation and
its identifier, as identifiers such as ``call_0`` come again in every
conversation.  Calls and results are made unique by pre-aggregation and meet in
a shuffled hash join on that pair, so one long conversation is dealt to all
tasks.  The order is topological: a call's level is 0 if it needs no other call,
else one more than the highest level it needs.
Arguments are parsed to variants, whose objects keep keys in order, so writing
them again, with one form for equal numbers, gives canonical JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import runtime

#: For a JSON type, what Spark calls the types of its values.
_KINDS = {
    "string": "^STRING$", "integer": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\\(\\d+,0\\))$", "number": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\\(.*|DOUBLE|FLOAT)$",
    "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<", "null": "^VOID$",
}
#: Strings, numbers and all else of a JSON text without spaces; possessive, so
#: that Java matches long texts without recursion.
_TOKEN = r'("(?:[^"\\]++|\\.)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++)'
#: Digits that a number may have before it is written with an exponent.
_PLAIN_DIGITS = 40
#: Needs of a call, at most, of which those that others imply are looked for.
MOST_REDUCED = 16


def json_string(text: Column) -> Column:
    """A text as a JSON string, or null as ``null``."""
    quoted = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def _number(token: Column) -> Column:
    """The one form of a JSON number: no exponent up to 40 digits, no idle zeros."""
    power = F.coalesce(F.nullif(F.regexp_extract(token, r"[eE]\+?(-?\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    whole, part = F.regexp_extract(token, r"^-?(\d+)", 1), F.regexp_extract(token, r"\.(\d+)", 1)
    digits = F.regexp_replace(F.concat(whole, part), "^0+", "")
    short = F.regexp_replace(digits, "0+$", "")
    shift = power - F.length(part) + F.length(digits) - F.length(short)
    sign = F.when(token.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    point = F.length(short) + shift
    plain = (
        F.when(shift >= 0, F.concat(short, F.repeat(F.lit("0"), F.greatest(shift, F.lit(0)))))
        .when(point > 0, F.concat(F.substr(short, F.lit(1), point), F.lit("."), F.substr(short, point + 1)))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), short))
    )
    long = (point > _PLAIN_DIGITS) | (shift < -_PLAIN_DIGITS)
    return F.when(short == "", F.lit("0")).otherwise(F.concat(sign, F.when(long, F.concat(short, F.lit("e"), shift.cast("string"))).otherwise(plain)))


def canonical_json(value: Column) -> Column:
    """A variant as JSON: keys in order, no spaces, equal numbers alike; null if it is null."""
    said = F.to_json(value)
    tokens = F.regexp_extract_all(said, F.lit(_TOKEN), F.lit(1))
    odd = F.transform(tokens, lambda t: F.when(t.rlike(r"^-?[0-9].*[.eE]|^-0$"), _number(t)).otherwise(t))
    return F.when(said.rlike(r"[0-9][.eE]|-0"), F.array_join(odd, "")).otherwise(said)


def _whole(value: Column) -> Column:
    number = F.when(F.schema_of_variant(value).rlike(_KINDS["number"]), F.try_variant_get(value, "$", "double"))
    return F.coalesce(number == F.floor(number), F.lit(False))


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with the arguments (a variant or null), as an array of strings.

    A schema has ``properties`` (name to a JSON type or a list of them) and
    ``required`` (names).  Properties that it does not name are allowed.  A JSON
    null counts as missing unless ``null`` is among the types; a number without
    a fraction is an integer however it is written.
    """
    kind = F.schema_of_variant(arguments)
    given = F.try_variant_get(arguments, "$", "map<string,variant>")
    out = F.array(F.concat(F.lit("unknown tool: "), F.coalesce(name, F.lit(""))))
    for tool, schema in sorted(schemas.items()):
        found = [F.lit(None).cast("string")]
        for key in sorted({*schema.get("properties", {}), *schema.get("required", ())}):
            types = schema.get("properties", {}).get(key, [])
            types = [types] if isinstance(types, str) else list(types)
            if unknown := [t for t in types if t not in _KINDS]:
                raise ValueError(f"no JSON type: {unknown[0]}")
            value = F.try_element_at(given, F.lit(key))
            is_null = F.is_variant_null(value)
            missing = value.isNull() if "null" in types else value.isNull() | is_null
            if key in schema.get("required", ()):
                found.append(F.when(missing, F.lit(f"missing: {key}")))
            if types:
                fits = F.lit(False)
                for t in types:
                    fits = fits | (is_null if t == "null" else F.schema_of_variant(value).rlike(_KINDS[t]) | (_whole(value) if t == "integer" else F.lit(False)))
                found.append(F.when(~missing & ~fits, F.lit(f"not {' or '.join(types)}: {key}")))
        checked = F.when(arguments.isNull(), F.array(F.lit("not JSON"))).when(~kind.rlike(_KINDS["object"]), F.array(F.lit("not object"))).otherwise(F.array_compact(F.array(*found)).cast("array<string>"))
        out = F.when(name == tool, checked).otherwise(out)
    return out


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(``key``, ``level``) of every call that is not on or after a cycle.

    ``calls`` has each ``key`` (a struct with ``conv_id``) once; ``needs`` has
    ``key`` and ``need``, both of them calls of one conversation, each pair once.
    A need that another need of the call needs itself changes no level, so it is
    left out first; a conversation that lists the calls of many turns then is
    mostly a chain.  That does not hold on cycles, so conversations in which a
    need that was left out is on or after one are ordered again with all needs.
    """
    few = needs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, MOST_REDUCED)).select("key")
    middle = needs.join(few.hint("shuffle_hash"), "key").select("key", F.col("need").alias("via"))
    through = middle.join(needs.select(F.col("key").alias("via"), "need"), "via").where("via <> need and via <> key").select("key", "need")
    idle = runtime.cut(needs.join(through, ["key", "need"], "left_semi"))
    if idle.isEmpty():
        return _levels(calls, needs)
    found = runtime.cut(_levels(calls, runtime.cut(needs.join(idle, ["key", "need"], "left_anti"))))
    stuck = calls.select(F.col("key").alias("need")).join(found.select(F.col("key").alias("need")), "need", "left_anti")
    conv = lambda: F.struct("key.conv_id").alias("conv")
    again = runtime.cut(idle.join(stuck, "need", "left_semi").select(conv()).distinct())
    if again.isEmpty():
        return found
    of = lambda df, how: df.withColumn("conv", conv()).join(again, "conv", how).drop("conv")
    return of(found, "left_anti").unionByName(_levels(of(calls.select("key"), "left_semi"), of(needs, "left_semi")))


def _levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """As ``levels``, with the needs as they are.

    Chains of calls that need one other are walked by pointer doubling: a round
    rewrites only what still moves, and there are as many as the logarithm of
    the longest chain.  What is left are the calls that need several; a round
    settles one level of those and touches only edges of the level before.
    """
    spark = calls.sparkSession
    counts = runtime.cut(needs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")))
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    moving = counts.where("n = 1").select("key", F.col("need").alias("up"), one.alias("far"), F.lit(False).alias("ended"))
    n = F.coalesce("n", zero)
    ends = runtime.cut(calls.select("key").join(counts.hint("shuffle_hash"), "key", "left").where(n != 1).select("key", n.alias("n")))
    free = ends.where("n = 0").select("key", zero.alias("level"))
    # Walks that have ended, in the rounds in which they did.
    done = ends.select("key", F.col("key").alias("up"), zero.alias("far"))
    rounds = max(1, counts.where("n = 1").count()).bit_length() + 1
    for _ in range(rounds):
        if moving.isEmpty():
            break
        ahead = done.withColumn("over", F.lit(True)).unionByName(moving.select("key", "up", "far", F.lit(False).alias("over")))
        ahead = ahead.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"), "over")
        step = moving.select("key", "up", "far").join(ahead.hint("shuffle_hash"), "up").select("key", F.col("next").alias("up"), (F.col("far") + F.col("more")).alias("far"), F.col("over").alias("ended"))
        step = runtime.cut(step)
        done = done.unionByName(step.where("ended").select("key", "up", "far"))
        moving = step.where("not ended")
    several = ends.where("n > 1").select("key")
    if several.isEmpty():
        return done.select("key", F.col("far").alias("level"))
    # Edges among the ends, each with the steps between; one from a cycle has no start and is never met.
    edges = needs.join(several.hint("shuffle_hash"), "key").join(done.select(F.col("key").alias("need"), F.col("up").alias("from"), (F.col("far") + 1).alias("steps")).hint("shuffle_hash"), "need", "left")
    edges = edges.groupBy("key", "from").agg(F.max("steps").alias("steps"))
    # As many edges as a call's array of needs has at most, so a window holds few.
    edges = runtime.cut(edges.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key"))))
    rounds, last = runtime.Rounds(spark), free
    waiting = None
    while True:
        met = edges.join(last.select(F.col("key").alias("from"), F.col("level").alias("of")), "from").select("key", "n", one.alias("met"), (F.col("of") + F.col("steps")).alias("level"))
        met = met if waiting is None else met.unionByName(waiting)
        met = rounds.add(met.groupBy("key").agg(F.max("n").alias("n"), F.sum("met").alias("met"), F.max("level").alias("level")))
        last, waiting = met.where("met = n").select("key", "level"), met.where("met < n")
        if last.isEmpty():
            break
    at = rounds.all().where("met = n").select("key", "level").unionByName(free).select(F.col("key").alias("up"), "level")
    return done.join(at, "up").select("key", (F.col("level") + F.col("far")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, with its result, and one per result that has no call.

    ``calls`` has ``conv_id``, ``call_id``, ``seq``, ``name``, ``arguments`` (JSON
    text) and ``needs`` (array of ids of calls of the conversation); ``results``
    has ``conv_id``, ``call_id``, ``seq``, ``content``.  Gives ``conv_id``,
    ``call_id``, ``seq``, ``level``, ``name``, ``n_results``, ``errors`` (sorted)
    and ``canonical``: JSON with keys in order and no spaces.  Sorted by level,
    then seq, a conversation's calls follow what they need.  Other columns are
    not looked at.

    A call is known by (``conv_id``, ``call_id``); rows of a null ``conv_id`` are
    one conversation.  Of rows that repeat a pair the first by (seq, name,
    arguments, needs) counts and ``duplicate id`` is an error; of several results
    the first by (seq, content) counts.  A call without an identifier is a row of
    its own, with level null and the error ``no id``.  Results whose pair no call
    has make one row a pair, with null name and level and the error ``no call``
    (and ``no id`` if that is null).  A need that is no call is an error and
    holds nothing up; a call on or after a cycle has level null.  Null or
    malformed arguments are errors, not failures.  Empty tables give no rows.
    """
    no_needs = F.array().cast("array<string>")
    key = F.struct("conv_id", "call_id").alias("key")
    order = F.struct("seq", "name", "arguments", F.coalesce("needs", no_needs).alias("needs"))
    one = calls.where("call_id is not null").groupBy(key).agg(F.min(order).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    one = runtime.cut(one.select("key", "n_calls", "c.*"))
    first = results.groupBy(key).agg(F.min(F.struct("seq", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    first = first.select("key", F.col("r.seq").alias("result_seq"), F.col("r.content").alias("result"), "n_results")
    wanted = one.select("key", F.explode(F.array_distinct("needs")).alias("id")).select("key", F.struct(F.col("key.conv_id").alias("conv_id"), F.col("id").alias("call_id")).alias("need"))
    known = runtime.cut(wanted.join(one.select(F.col("key").alias("need"), F.lit(True).alias("is_call")).hint("shuffle_hash"), "need", "left"))
    level = levels(one, known.where("is_call").select("key", "need")).select("key", "level", F.lit(0).cast("long").alias("unknown"))
    lost = known.where("is_call is null").select("key", F.lit(None).cast("long").alias("level"), F.lit(1).cast("long").alias("unknown"))
    about = level.unionByName(lost).groupBy("key").agg(F.max("level").alias("level"), F.sum("unknown").alias("unknown"))
    met = one.withColumn("is_call", F.lit(True)).join(first.hint("shuffle_hash"), "key", "full").join(about.hint("shuffle_hash"), "key", "left")
    met = met.select("key.conv_id", "key.call_id", F.coalesce("seq", "result_seq").alias("seq"), "name", "arguments", "n_calls", "is_call", "level", "unknown", "result", "n_results")
    none = lambda kind: F.lit(None).cast(kind)
    nameless = calls.where("call_id is null").select(
        "conv_id", none("string").alias("call_id"), "seq", "name", "arguments", F.lit(1).cast("long").alias("n_calls"), F.lit(True).alias("is_call"), none("long").alias("level"), none("long").alias("unknown"), none("string").alias("result"), none("long").alias("n_results"),
    )
    parsed = met.unionByName(nameless).withColumn("parsed", F.try_parse_json("arguments"))
    is_call, has_id = F.col("is_call").isNotNull(), F.col("call_id").isNotNull()
    errors = F.concat(
        F.when(is_call, argument_errors(F.col("name"), F.col("parsed"), schemas)).otherwise(no_needs),
        F.array_compact(F.array(
            F.when(F.col("n_calls") > 1, F.lit("duplicate id")), F.when(is_call & F.col("n_results").isNull(), F.lit("no result")), F.when(~is_call, F.lit("no call")), F.when(~has_id, F.lit("no id")),
            F.when(F.col("unknown") > 0, F.lit("unknown need")), F.when(is_call & has_id & F.col("level").isNull(), F.lit("cycle")),
        )),
    )
    named = parsed.withColumn("errors", F.array_sort(errors)).withColumn("n_results", F.coalesce("n_results", F.lit(0)).cast("long"))
    canonical = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical_json(F.col("parsed")), F.lit("null")), F.lit(',"errors":'), F.to_json("errors"), F.lit(',"id":'), json_string(F.col("call_id")),
        F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")), F.lit(',"name":'), json_string(F.col("name")), F.lit(',"result":'), json_string(F.col("result")), F.lit("}"),
    )
    return named.select("conv_id", "call_id", "seq", "level", "name", "n_results", "errors", canonical.alias("canonical"))
