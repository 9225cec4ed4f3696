"""Chat formatting: tool-call linking.

``link_calls`` hash-joins calls and results by (conversation, identifier), orders calls so that each follows those
whose results it uses, validates arguments against the schema of the called tool and serialises one canonical JSON
record per call (keys sorted, no spaces).

Order: a call that uses the result of an earlier turn's call follows it by its turn; calls of one turn get levels in
rounds (a call's level is one more than the highest of those it uses), so rounds are as many as the longest chain
within one turn, not within a conversation.  Status, the first that holds:
  duplicate_id   the identifier is used by more than one call of the conversation
  bad_reference  it uses a call that does not exist or is of a later turn
  cycle          it uses itself, directly or through others of its turn (or lies between two such cycles)
  blocked        it uses a call in a cycle, directly or through others of its turn
  invalid        its arguments do not fit the schema (or there is no schema for the name)
  unanswered     no result has its identifier
  linked         otherwise
  no_call        (a result, not a call) no call has its identifier
``more_results`` counts results beyond the first (by turn, then content).

Canonical JSON: names sorted at every level, no spaces; values that are objects or lists are read as JSON and written anew.

Defined cases: calls with a null conversation or identifier get status ``no_id`` and are never joined; results with such
nulls, or without a call, give a row of their own per conversation and identifier (``no_call``); null arguments
are an empty object; arguments that are no JSON stay as they are and are invalid; null results count as answered with null
content; very long texts are values like others; exact repeats of a call or a result row count once; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm.common import stage, table

KEY = ["conv_id", "call_id"]
#: (tool, argument, type, required): types are string, integer, number, boolean, array and object.
REPLY_SCHEMAS = [("reply", "prompt", "string", True), ("reply", "words", "integer", True),
                 ("configure", "prompt", "string", True), ("configure", "words", "integer", True),
                 ("note", "about", "object", True), ("note", "tags", "array", True), ("check", "note", "string", True)]


def has_type(value: Column, kind: Column) -> Column:
    """Whether a JSON value (as compact text) has the type."""
    number = value.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    return (F.when(kind == "string", value.startswith('"'))
            .when(kind == "integer", value.rlike(r"^-?(0|[1-9][0-9]*)$"))
            .when(kind == "number", number)
            .when(kind == "boolean", value.isin("true", "false"))
            .when(kind == "array", value.startswith("[") & F.try_parse_json(value).isNotNull())
            .when(kind == "object", value.startswith("{") & F.try_parse_json(value).isNotNull())
            .otherwise(F.lit(False)))


def json_text(value: Column) -> Column:
    """A string as a JSON string."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":|\}$', "")


def canonical_value(value: Column) -> Column:
    """JSON text with the names of all its objects sorted and without spaces (a VARIANT keeps its names in order)."""
    nested = F.to_json(F.try_parse_json(F.when(value.rlike(r"^\s*[\[{]"), value)))
    return F.coalesce(nested, value, F.lit("null"))


def canonical_object(pairs: Column) -> Column:
    """JSON object of a map from names to JSON texts: names sorted, no spaces."""
    entries = F.array_sort(F.map_entries(pairs))
    return F.concat(F.lit("{"), F.array_join(F.transform(
        entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def rounds(nodes: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Levels (conv_id, call_id, level) of the calls that do not depend on a cycle, and the uses of the others.

    ``uses`` holds (conv_id, call_id, used_id) between calls of one turn.  Each round takes the calls all of whose used
    calls have levels.
    """
    used = uses.select("conv_id", "call_id").distinct()
    done = nodes.select(*KEY).join(used, KEY, "left_anti").withColumn("level", F.lit(0).cast("int"))
    open_uses = uses
    if open_uses.isEmpty():
        return done, uses
    done = stage(done, "levels")
    while True:
        ready = done.select("conv_id", F.col("call_id").alias("used_id"), "level")
        got = open_uses.join(ready, ["conv_id", "used_id"], "left").groupBy(*KEY).agg(
            F.max("level").alias("top"), F.count("*").alias("n"), F.count("level").alias("known"))
        fresh = stage(got.where("n = known").select(*KEY, (F.col("top") + 1).alias("level")), "levels")
        if fresh.isEmpty():
            return done, open_uses
        done = stage(done.unionByName(fresh), "levels")
        open_uses = stage(open_uses.join(fresh.select(*KEY), KEY, "left_anti"), "uses")


def order_within_turns(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, blocked): calls on or behind a cycle have no level, those only behind one are ``blocked``."""
    levels, left = rounds(calls, uses)
    levels = levels.withColumn("blocked", F.lit(False))
    if left.isEmpty():
        return levels
    # The same rounds against the direction of use: what no call of a cycle depends on.  What stays is on a cycle.
    behind = left.select(*KEY).distinct()
    among = left.join(behind.select("conv_id", F.col("call_id").alias("used_id")), ["conv_id", "used_id"], "left_semi")
    turned = among.select("conv_id", F.col("used_id").alias("call_id"), F.col("call_id").alias("used_id"))
    free, _ = rounds(behind, stage(turned, "turned"))
    none = F.lit(None).cast("int").alias("level")
    blocked = behind.join(free.select(*KEY, F.lit(True).alias("b")), KEY, "left").select(
        *KEY, none, F.coalesce("b", F.lit(False)).alias("blocked"))
    return levels.unionByName(blocked)


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: (conv_id, call_id, turn, level, status, more_results, record).

    ``calls``: conv_id, call_id, turn, name, arguments (map of names to JSON texts), uses (array of call ids).
    ``results``: conv_id, call_id, turn, content (string).  ``schemas``: name, argument, type, required; they are
    configuration, grouped to one row per tool.
    """
    base = calls.select("conv_id", "call_id", "turn", "name",
                        F.coalesce("arguments", F.create_map().cast("map<string,string>")).alias("arguments"),
                        F.coalesce("uses", F.array().cast("array<string>")).alias("uses"))
    # Maps can't be grouping keys, their canonical text can.
    base = base.withColumn("arguments", F.transform_values("arguments", lambda _, v: canonical_value(v)))
    base = base.withColumn("object", canonical_object(F.col("arguments")))
    base = base.groupBy("conv_id", "call_id", "turn", "name", "object", "uses").agg(F.first("arguments").alias("arguments"))
    base = stage(base, "calls")
    lost = base.where(F.col("conv_id").isNull() | F.col("call_id").isNull())
    known = base.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())

    # A call's own identity: how many distinct calls share its identifier.
    ids = known.groupBy(*KEY).agg(F.count("*").alias("same_id"), F.min("turn").alias("id_turn"))
    edges = known.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("uses")).alias("used_id"))
    target = ids.select("conv_id", F.col("call_id").alias("used_id"), F.col("id_turn").alias("used_turn"))
    edges = stage(edges.join(target, ["conv_id", "used_id"], "left"), "edges")
    bad = (edges.where(F.col("used_turn").isNull() | (F.col("used_turn") > F.col("turn")))
           .select(*KEY).distinct().withColumn("bad", F.lit(True)))
    inner = edges.where(F.col("used_turn") == F.col("turn")).select(*KEY, "used_id").distinct()
    levels = order_within_turns(ids.select(*KEY), inner)

    # The first result by turn, then content; later ones are counted.  Repeated rows count once.
    heard = results.select(*KEY, "turn", "content").distinct()
    answer = (heard.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
              .groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("first"), F.count("*").alias("n_results")))

    rules = schemas.groupBy("name").agg(F.collect_set(F.struct("argument", "type", "required")).alias("rules"))
    value = F.col("arguments")
    fits = F.forall("rules", lambda r: F.when(F.map_contains_key(value, r["argument"]),
                                              has_type(F.element_at(value, r["argument"]), r["type"]))
                    .otherwise(~r["required"]))
    named = F.forall(F.map_keys(value), lambda k: F.exists("rules", lambda r: r["argument"] == k))
    joined = (known.join(ids.drop("id_turn"), KEY).join(levels, KEY, "left").join(bad, KEY, "left")
              .join(answer, KEY, "left").join(rules, "name", "left"))
    status = (F.when(F.col("same_id") > 1, "duplicate_id").when(F.col("bad"), "bad_reference")
              .when(F.col("level").isNull(), F.when(F.col("blocked"), "blocked").otherwise("cycle"))
              .when(~F.coalesce(fits & named, F.lit(False)), "invalid")
              .when(F.col("n_results").isNull(), "unanswered").otherwise("linked"))
    content = F.col("first.content")
    record = F.concat(
        F.lit('{"arguments":'), F.col("object"), F.lit(',"id":'), json_text(F.col("call_id").cast("string")),
        F.lit(',"name":'), F.coalesce(json_text(F.col("name")), F.lit("null")),
        F.lit(',"result":'), F.when(content.isNull(), F.lit("null")).otherwise(json_text(content)), F.lit("}"))
    out = joined.select(*KEY, "turn", "level", status.alias("status"),
                        F.greatest(F.coalesce("n_results", F.lit(0)) - 1, F.lit(0)).alias("more_results"),
                        record.alias("record"))
    none = F.lit(None).cast("int").alias("level")
    out = out.unionByName(lost.select(*KEY, "turn", none, F.lit("no_id").alias("status"),
                                      F.lit(0).cast("long").alias("more_results"), F.lit(None).cast("string").alias("record")))
    orphans = heard.join(ids.select(*KEY), KEY, "left_anti").groupBy(*KEY).agg(
        F.min(F.struct("turn", "content")).alias("first"), F.count("*").alias("n_results"))
    shown = lambda c: F.coalesce(json_text(c), F.lit("null"))
    text = F.concat(F.lit('{"arguments":null,"id":'), shown(F.col("call_id").cast("string")), F.lit(',"name":null,"result":'),
                    F.when(content.isNull(), F.lit("null")).otherwise(json_text(content)), F.lit("}"))
    return out.unionByName(orphans.select(*KEY, F.col("first.turn").alias("turn"), none, F.lit("no_call").alias("status"),
                                          (F.col("n_results") - 1).alias("more_results"), text.alias("record")))


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the turns of a conversation stand for.

    A user or system turn calls a tool named after its role ("reply", "configure") with its text and word count;
    its identifier is the turn's number.  An assistant turn is the result of the call one turn earlier.  A user
    turn uses the result of the user turn two before, when the conversation has it.

    Each such turn also calls "note" about it (identifier: turn, then "n"), with nested arguments, which uses the turn's first
    call.  By the number of words modulo 7 a note uses itself, too (0), or a call that does not exist (2), or has
    tags of the wrong type (3).  After a note that uses itself, a call "check" (turn, then "c") uses the note.
    """
    turns = conversations.where(F.col("turn").isNotNull()).select("conv_id", "turn", "role", "text")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    asking = turns.where(F.col("role").isin("user", "system"))
    earlier = (turns.where(F.col("role") == "user").groupBy("conv_id", "turn").agg(F.lit(True).alias("has"))
               .select("conv_id", (F.col("turn") + 2).alias("turn"), "has"))
    calls = asking.join(earlier, ["conv_id", "turn"], "left").select(
        "conv_id", F.col("turn").cast("string").alias("call_id"), "turn",
        F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"),
        F.create_map(F.lit("words"), words.cast("string"),
                     F.lit("prompt"), json_text(F.coalesce("text", F.lit("")))).alias("arguments"),
        F.when(F.col("has") & (F.col("role") == "user"), F.array((F.col("turn") - 2).cast("string")))
        .otherwise(F.array().cast("array<string>")).alias("uses"))
    asked = asking.select("conv_id", "turn", "role", words.alias("words"), F.col("turn").cast("string").alias("id")).distinct()
    kind, note_id = F.col("words") % 7, F.concat("id", F.lit("n"))
    about = F.concat(F.lit('{"words": '), F.col("words"), F.lit(', "turn": {"role": "'), F.col("role"), F.lit('", "id": '),
                     F.col("id"), F.lit("}}"))
    tags = F.when(kind == 3, F.lit('"none"')).otherwise(F.concat(F.lit('["'), F.col("role"), F.lit('", '), F.col("words"), F.lit("]")))
    notes = asked.select(
        "conv_id", note_id.alias("call_id"), "turn", F.lit("note").alias("name"),
        F.create_map(F.lit("tags"), tags, F.lit("about"), about).alias("arguments"),
        F.when(kind == 0, F.array("id", note_id)).when(kind == 2, F.array("id", F.concat("id", F.lit("x"))))
        .otherwise(F.array("id")).alias("uses"))
    checks = asked.where(kind == 0).select(
        "conv_id", F.concat("id", F.lit("c")).alias("call_id"), "turn", F.lit("check").alias("name"),
        F.create_map(F.lit("note"), json_text(note_id)).alias("arguments"), F.array(note_id).alias("uses"))
    calls = calls.unionByName(notes).unionByName(checks)
    results = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` as linked, ordered, validated calls; the record as its SHA-256."""
    calls, results = turns_as_calls(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(REPLY_SCHEMAS, "name string, argument string, type string, required boolean")
    return link_calls(calls, results, schemas).select(
        *KEY, "turn", "level", "status", "more_results", F.sha2("record", 256).alias("record_sha256"))


OP2_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE turn IS NOT NULL),
     a AS (SELECT conv_id, turn - 1 AS turn, min({'turn': turn, 'text': text}) AS first, count(*) AS n
           FROM t WHERE role = 'assistant' GROUP BY ALL),
     u AS (SELECT conv_id, turn, text, role, count(*) OVER (PARTITION BY conv_id, turn) AS same
           FROM t WHERE role IN ('user', 'system')),
     j AS (SELECT u.*, a.n, a.first,
                  '{"arguments":{"prompt":' || to_json(coalesce(u.text, '')) || ',"words":' ||
                  len(list_filter(regexp_split_to_array(coalesce(u.text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) ||
                  '},"id":"' || u.turn || '","name":"' || CASE u.role WHEN 'user' THEN 'reply' ELSE 'configure' END ||
                  '","result":' || CASE WHEN a.first.text IS NULL THEN 'null' ELSE to_json(a.first.text) END || '}' AS record
           FROM u LEFT JOIN a USING (conv_id, turn)),
     w AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS same FROM (SELECT DISTINCT conv_id, turn, role,
             len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS words
           FROM u))
SELECT conv_id, CAST(turn AS VARCHAR) AS call_id, turn, CAST(0 AS INTEGER) AS level,
       CASE WHEN conv_id IS NULL THEN 'no_id' WHEN same > 1 THEN 'duplicate_id' WHEN n IS NULL THEN 'unanswered'
            ELSE 'linked' END AS status,
       greatest(coalesce(n, 0) - 1, 0) AS more_results, sha256(record) AS record_sha256
FROM j
UNION ALL
SELECT conv_id, turn || 'n', turn, CASE WHEN words % 7 <> 0 THEN 1 END,
       CASE WHEN same > 1 THEN 'duplicate_id' WHEN words % 7 = 2 THEN 'bad_reference' WHEN words % 7 = 0 THEN 'cycle'
            WHEN words % 7 = 3 THEN 'invalid' ELSE 'unanswered' END, 0,
       sha256('{"arguments":{"about":{"turn":{"id":' || turn || ',"role":"' || role || '"},"words":' || words || '},"tags":' ||
              CASE WHEN words % 7 = 3 THEN '"none"' ELSE '["' || role || '",' || words || ']' END ||
              '},"id":"' || turn || 'n","name":"note","result":null}')
FROM w
UNION ALL
SELECT conv_id, turn || 'c', turn, NULL, CASE WHEN same0 > 1 THEN 'duplicate_id' ELSE 'blocked' END, 0,
       sha256('{"arguments":{"note":"' || turn || 'n"},"id":"' || turn || 'c","name":"check","result":null}')
FROM (SELECT conv_id, turn, count(*) AS same0 FROM w WHERE words % 7 = 0 GROUP BY ALL)
UNION ALL
SELECT conv_id, CAST(turn AS VARCHAR), a.first.turn, NULL, 'no_call', n - 1,
       sha256('{"arguments":null,"id":"' || turn || '","name":null,"result":' ||
              CASE WHEN a.first.text IS NULL THEN 'null' ELSE to_json(a.first.text) END || '}')
FROM a ANTI JOIN u USING (conv_id, turn)
"""
