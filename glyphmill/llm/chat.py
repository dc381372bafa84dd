"""Chat formatting with tool-call linking, in DataFrame functions alone.

Messages are rows (conv_id, turn, role, text).  Where the text is a JSON object it may carry tool data:

* ``system``: ``tools``, each with ``name`` and ``parameters`` (a schema), perhaps inside ``function``;
* ``assistant``: ``tool_calls``, each with ``id``, ``name`` and ``arguments`` (an object, or a string that holds one),
  perhaps inside ``function``, perhaps with ``depends_on`` (ids);
* ``tool``: ``tool_call_id`` and ``content``.

An argument string ``$result:ID`` also makes a call depend on the call ID.  Calls and results are joined by (conv_id, id);
calls are ordered by their dependencies (a call's level is one more than the greatest of those it needs); arguments are
checked against the tool's schema; each message is written as JSON with sorted keys and no spare white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.session import stored

#: Where calls in or behind a cycle are ordered: after all others.
_LAST = 2**31 - 1


#: JSON is read without the parser's bounds of strings and digits.  Values are nested 1,000 deep at most: variants are made
#: by calls inside calls, which a thread has no more room for.
_BOUNDS = "map('maxStringLen', '2147483647', 'maxNumLen', '2147483647', 'maxNestingDepth', '1000')"
#: Whether a text is JSON at all is asked without any bound; nothing is made of it.
_NO_BOUNDS = "map('maxStringLen', '2147483647', 'maxNumLen', '2147483647', 'maxNestingDepth', '2147483647', 'columnNameOfCorruptRecord', 'broken')"
#: Stand for an escaped backslash and an escaped quote while strings are told from what is between them, and before
#: numbers that are kept as they are written: no JSON has noncharacters in it for a reason.
_BACKSLASH, _QUOTE, _DIGITS = "\ufdd0", "\ufdd1", "\ufdd2"
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
#: Digits that a number may have before it is kept as written: what a decimal holds.
_EXACT = 38


def _parsed(json: str) -> Column:
    """A variant of JSON of any length and depth; of equal keys in one object the last counts.  Null for what is no JSON."""
    return F.expr(f"from_json({json}, 'variant', {_BOUNDS})")


def _plain_number(token: Column) -> Column:
    """One spelling for equal numbers.  Exponents are written out from 1e-6 up to below 1e21, and else as the shortest
    digits with a sign and an exponent; numbers of more digits than a decimal holds stay as they are written."""
    value = token.cast("double")
    whole = F.abs(value) < 1e21
    written = F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(value.cast("decimal(38,17)").cast("string"), "0+$", ""), "[.]$", ""))
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(value.cast("string"), "[.]0E", "E"), "E-", "e-"), "E", "e+")
    kept = lambda of: F.concat(F.lit(f'"{_DIGITS}'), of, F.lit('"'))
    exponent = F.when(F.abs(value) == float("inf"), kept(F.lower(token))).when(value == 0, F.lit("0")).when(whole & (F.abs(value) >= 1e-6), written).otherwise(kept(short))
    return F.when(token.rlike("[eE]"), exponent).when(F.length(F.regexp_replace(token, "[^0-9]", "")) >= _EXACT, kept(token)).otherwise(token)


def _with_plain_numbers(text: Column) -> Column:
    """JSON whose numbers a variant holds as they are, or which are strings that begin with a sign of their own.

    Only texts with an exponent or a long number outside of strings can need it, so the others are not taken apart."""
    hidden = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    between = lambda part: F.array_join(F.transform(F.regexp_extract_all(part, F.lit(f"{_NUMBER}|[^0-9-]+|-"), F.lit(0)), lambda t: F.when(t.rlike(f"^{_NUMBER}$"), _plain_number(t)).otherwise(t)), "")
    parts = F.transform(F.regexp_extract_all(hidden, F.lit('"[^"]*"|[^"]+'), F.lit(0)), lambda p: F.when(p.startswith('"'), p).otherwise(between(p)))
    made = F.replace(F.replace(F.array_join(parts, ""), F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    needed = text.rlike(f"[0-9][eE][+-]?[0-9]|[0-9.]{{{_EXACT},}}") & ~text.rlike(f"[{_BACKSLASH}{_QUOTE}{_DIGITS}]")
    return F.when(needed, made).otherwise(text)


def _json(of: str) -> str:
    """A variant as JSON, with its kept numbers."""
    return f"regexp_replace(to_json({of}), '\"{_DIGITS}([^\"]*)\"', '$1')"


def _get(of: str, path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({of}, '{path}', '{kind}')")


def _read(conversations: DataFrame) -> DataFrame:
    """Messages with their JSON and a hash that stands for the message; repeated rows share it."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("kind", F.lower(F.coalesce("role", F.lit(""))))
    conversations.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spoken = F.col("kind").isin("system", "assistant", "tool") & F.ltrim("text", F.lit(" \t\n\r")).startswith("{")
    rows = rows.withColumn("message", F.xxhash64("conv_id", "turn", "role", "text", F.length("text"))).withColumn("plain", F.when(spoken, _with_plain_numbers(F.col("text"))))
    rows = rows.withColumn("json", _parsed("plain"))
    # JSON without fault that no variant holds
    lost = F.col("plain").isNotNull() & F.col("json").isNull() & F.expr(f"from_json(plain, 'broken string', {_NO_BOUNDS}).broken is null")
    return rows.withColumn("unreadable", F.coalesce(lost, F.lit(False))).drop("plain")


def _calls(messages: DataFrame) -> DataFrame:
    """A row for each tool call of a message: its place, id, name and arguments."""
    listed = messages.where("kind = 'assistant' and json is not null").select("conv_id", "turn", "message", _get("json", "$.tool_calls", "array<variant>").alias("list")).where("list is not null")
    each = listed.dropDuplicates(["message"]).select("conv_id", "turn", "message", F.posexplode("list").alias("place", "call"))
    each = each.withColumns({
        "id": F.coalesce(_get("call", "$.id", "string"), _get("call", "$.function.id", "string")),
        "name": F.coalesce(_get("call", "$.name", "string"), _get("call", "$.function.name", "string")),
        "given": F.coalesce(_get("call", "$.arguments", "variant"), _get("call", "$.function.arguments", "variant")),
    })
    each = each.withColumn("string_arguments", _with_plain_numbers(F.expr("try_variant_get(given, '$', 'string')")))
    each = each.withColumn("arguments", F.when(F.expr("schema_of_variant(given) = 'STRING'"), _parsed("string_arguments")).otherwise(F.col("given")))
    needs = F.array_union(F.coalesce(_get("call", "$.depends_on", "array<string>"), F.array().cast("array<string>")), F.coalesce(F.regexp_extract_all(F.expr("to_json(arguments)"), F.lit(r'"\$result:([^"]*)"'), F.lit(1)), F.array().cast("array<string>")))
    return each.withColumn("needs", F.array_except(needs, F.array(F.lit(None).cast("string")))).drop("given", "call", "string_arguments")


def _tools(messages: DataFrame) -> DataFrame:
    """One schema for each tool name of a conversation; of several the first by turn."""
    listed = messages.where("kind = 'system' and json is not null").select("conv_id", "turn", "message", F.explode(_get("json", "$.tools", "array<variant>")).alias("tool"))
    each = listed.select("conv_id", F.coalesce(_get("tool", "$.name", "string"), _get("tool", "$.function.name", "string")).alias("name"), F.struct("turn", "message", F.expr("to_json(coalesce(try_variant_get(tool, '$.parameters', 'variant'), try_variant_get(tool, '$.function.parameters', 'variant')))").alias("schema")).alias("first"))
    found = each.where("name is not null").groupBy("conv_id", "name").agg(F.min("first").alias("first"))
    return found.select("conv_id", "name", F.lit(True).alias("known"), _parsed("first.schema").alias("schema"))


#: What a schema's type name allows of a value's own type (``k``).
_FITS = """case t when 'string' then k = 'STRING' when 'integer' then k = 'BIGINT' or (k rlike '^(DECIMAL|DOUBLE)' and number = rint(number))
 when 'number' then k = 'BIGINT' or k rlike '^(DECIMAL|DOUBLE|FLOAT)' when 'boolean' then k = 'BOOLEAN' when 'object' then k rlike '^OBJECT' when 'array' then k rlike '^ARRAY' when 'null' then k = 'VOID' else true end"""


def _of(value: str) -> Column:
    return _parsed(value)


#: What is read of a schema, and what only describes.
_READ = ("type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems", "items", "required", "properties", "additionalProperties")
_TELLS = ("title", "description", "default", "examples", "format", "$schema", "$id", "$comment", "deprecated", "readOnly", "writeOnly", "strict", "name")
#: Patterns that mean the same here as where schemas are written and cannot be malformed: single characters, plain
#: classes, and counts.
_SAFE_PATTERN = r"^\\^?(?:(?:[A-Za-z0-9 _@:/,;#%&=<>~.-]|\\\\[dwsDWS.+*?/-]|\\[\\^?(?:a-z|A-Z|0-9|[A-Za-z0-9_ @.])+-?\\])(?:[+*?]|\\{[0-9]{1,3},?\\})?)*\\$?$"


def _faults(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (message, place, path, value, schema), value and schema as JSON: the faults of each value by itself, and the
    values inside it that a schema speaks of."""
    at = nodes.withColumns({"v": _of("value"), "s": _of("schema")})
    at = at.withColumns({
        "k": F.expr("schema_of_variant(v)"), "types": F.expr("coalesce(try_variant_get(s, '$.type', 'array<string>'), array(try_variant_get(s, '$.type', 'string')))"),
        "has": F.expr("try_variant_get(v, '$', 'map<string,variant>')"), "items": F.expr("try_variant_get(v, '$', 'array<variant>')"),
        "known": F.expr("coalesce(try_variant_get(s, '$.properties', 'map<string,variant>'), map())"),
        "pattern": F.expr("try_variant_get(s, '$.pattern', 'string')"), "rules": F.expr("map_keys(try_variant_get(s, '$', 'map<string,variant>'))"),
        "others": F.expr("try_variant_get(s, '$.additionalProperties', 'variant')"), "listed": F.expr("try_variant_get(s, '$.enum', 'array<variant>')"),
    })
    kept = f"startswith(try_variant_get(v, '$', 'string'), '{_DIGITS}')"  # a number that is kept as written
    at = at.withColumn("kept", F.expr(f"if(k = 'STRING' and {kept}, cast(substr(try_variant_get(v, '$', 'string'), 2) as double), null)")).withColumn("k", F.expr("if(kept is null, k, 'DOUBLE')"))
    at = at.withColumns({"has": F.expr("if(k rlike '^OBJECT', has, null)"), "items": F.expr("if(k rlike '^ARRAY', items, null)"), "number": F.expr("coalesce(kept, if(k rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)', try_variant_get(v, '$', 'double'), null))")})
    at = at.withColumns({"long": F.expr("if(k = 'STRING', length(variant_get(v, '$', 'string')), null)"), "shown": F.expr("if(path = '', 'arguments', path)"), "before": F.expr("if(path = '', '', concat(path, '.'))")})
    limit = lambda name: f"try_variant_get(s, '$.{name}', 'double')"
    one = lambda test, says: f"if(coalesce({test}, false), array(concat(shown, ': {says}')), array())"
    found = F.expr(
        f"""concat({one(f"not exists(types, t -> {_FITS})", "wrong type")},
        {one("not exists(listed, e -> to_json(e) = to_json(v))", "not in the list")}, {one("to_json(try_variant_get(s, '$.const', 'variant')) <> to_json(v)", "not the constant")},
        {one(f"number < {limit('minimum')} or number > {limit('maximum')} or number <= {limit('exclusiveMinimum')} or number >= {limit('exclusiveMaximum')}", "out of range")},
        {one(f"coalesce(long < {limit('minLength')}, false) or coalesce(long > {limit('maxLength')}, false)", "wrong length")},
        {one(f"abs(number / {limit('multipleOf')} - round(number / {limit('multipleOf')})) > 1e-9 * greatest(1, abs(number / {limit('multipleOf')}))", "not a multiple")},
        {one(f"if(pattern rlike '{_SAFE_PATTERN}', not if(pattern rlike '{_SAFE_PATTERN}', variant_get(if(k = 'STRING', v, null), '$', 'string') rlike if(pattern rlike '{_SAFE_PATTERN}', pattern, ''), true), false)", "not of the pattern")},
        {one("try_variant_get(s, '$.uniqueItems', 'boolean') and size(array_distinct(transform(items, x -> to_json(x)))) < size(items)", "items repeat")},
        {one(f"coalesce(size(items) < {limit('minItems')}, false) or coalesce(size(items) > {limit('maxItems')}, false)", "wrong number of items")},
        if(has is null, array(), transform(filter(array_distinct(coalesce(try_variant_get(s, '$.required', 'array<string>'), array())), n -> not map_contains_key(has, n)), n -> concat(before, n, ': missing'))),
        if(has is null or coalesce(try_variant_get(others, '$', 'boolean'), true), array(), transform(filter(map_keys(has), n -> not map_contains_key(known, n)), n -> concat(before, n, ': not in the schema'))))"""
    )
    names = ", ".join(f"'{n}'" for n in (*_READ, *_TELLS))
    more = F.expr(f"""concat(array_except(rules, array({names})), if(pattern is not null and not pattern rlike '{_SAFE_PATTERN}', array('pattern'), array()),
        if(array_contains(rules, 'items') and try_variant_get(s, '$.items', 'map<string,variant>') is null, array('items'), array()))""")
    unread = at.select("message", "place", F.explode(more).alias("rule"), "shown").select("message", "place", F.concat("shown", F.lit(": not checked: "), "rule").alias("problem"), F.lit(True).alias("unread"))
    problems = at.select("message", "place", F.explode(found).alias("problem"), F.lit(False).alias("unread")).unionByName(unread)
    rule = "coalesce(known[n], if(schema_of_variant(others) rlike '^OBJECT', others, null))"
    members = F.expr(f"transform(filter(map_keys(has), n -> {rule} is not null), n -> named_struct('path', concat(before, n), 'value', to_json(has[n]), 'schema', to_json({rule})))")
    entries = F.expr("if(try_variant_get(s, '$.items', 'map<string,variant>') is null, null, transform(items, (x, i) -> named_struct('path', concat(path, '[', i, ']'), 'value', to_json(x), 'schema', to_json(try_variant_get(s, '$.items', 'variant')))))")
    inner = at.select("message", "place", F.explode(F.coalesce(members, entries)).alias("x")).select("message", "place", "x.path", "x.value", "x.schema")
    return problems, inner


def _problems(calls: DataFrame) -> DataFrame:
    """(message, place, problems) of the calls (message, place, arguments, schema) with faults: short texts, in order.

    Values are followed into objects (``properties``, ``additionalProperties``) and arrays (``items``) level by level, as
    rows, to any depth.  Checked of each: ``type`` (one name or several), ``enum``, ``const``, ``minimum``, ``maximum`` and
    the exclusive ones, ``multipleOf``, ``minLength``, ``maxLength``, ``minItems``, ``maxItems``, ``uniqueItems``,
    ``required``, ``additionalProperties``, and ``pattern`` where it is of single characters, plain classes and counts.
    What else a schema says of a value that is given (other patterns, references, combinations of schemas, lists of item
    schemas) is told as ``not checked``; ``unread`` where there are no other problems.
    """
    no_object = calls.where("arguments is null or schema_of_variant(arguments) not rlike '^OBJECT'").select("message", "place", F.lit("arguments are not an object").alias("problem"), F.lit(False).alias("unread"))
    nodes = calls.where("schema is not null and schema_of_variant(arguments) rlike '^OBJECT'").select("message", "place", F.lit("").alias("path"), F.expr("to_json(arguments)").alias("value"), F.expr("to_json(schema)").alias("schema"))
    nodes = stored(nodes, "nodes")
    every = no_object
    while not nodes.isEmpty():
        problems, inner = _faults(nodes)
        every = every.unionByName(problems)
        nodes = stored(inner, "nodes")
    return every.groupBy("message", "place").agg(F.array_sort(F.collect_set("problem")).alias("problems"), F.bool_and("unread").alias("unread"))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) of calls that depend on others; level -1 for those in or behind a cycle.

    Calls with one need are chains: each learns the end of its chain and how far it is by doubling, so a chain of n calls
    takes log2 n rounds.  Then levels go from call to call that has several needs, over chains at one step; of these there
    are as many rounds as the longest such path has calls with several needs.
    """
    key = ["conv_id", "id"]
    nodes = calls.where("id is not null").select(*key).distinct()
    edges = calls.where("id is not null").select(*key, F.explode("needs").alias("need")).distinct()
    edges = stored(edges.join(nodes.withColumnRenamed("id", "need"), ["conv_id", "need"], "left_semi"), "needs")
    if edges.isEmpty():
        return edges.select(*key, F.lit(0).alias("level")).limit(0)
    many = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("need").alias("end"))
    one = many.where("n = 1").select(*key, "end", F.lit(1).alias("steps"))
    at = lambda df, name: df.withColumnRenamed("id", name)
    chains = stored(one.join(at(one.select(*key), "end").withColumn("open", F.lit(True)), ["conv_id", "end"], "left").select(*key, "end", "steps", F.coalesce("open", F.lit(False)).alias("open")), "chains")
    waiting = chains.where("open").count()
    while waiting:
        on = at(chains.select(*key, F.col("end").alias("next"), F.col("steps").alias("more"), F.col("open").alias("still")), "end")
        jumped = chains.where("open").join(on, ["conv_id", "end"]).select(*key, F.col("next").alias("end"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open"))
        chains = stored(chains.where("not open").unionByName(jumped), "chains")
        left = chains.where("open").count()
        if left == waiting:  # no chain came to its end: these run into cycles
            break
        waiting = left
    ends = chains.where("not open").select(*key, "end", "steps")
    several = many.where("n > 1").select(*key)
    arms = edges.join(several, key, "left_semi").join(at(ends, "need"), ["conv_id", "need"], "left").select(*key, F.coalesce("end", "need").alias("need"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    arms = stored(arms, "arms")
    known = stored(nodes.join(edges.select(*key).distinct(), key, "left_anti").join(edges.select("conv_id", F.col("need").alias("id")).distinct(), key, "left_semi").withColumn("level", F.lit(0)), "levels")
    while not arms.isEmpty():
        of = arms.join(at(known, "need"), ["conv_id", "need"], "left").groupBy(*key).agg(F.count("*").alias("n"), F.count("level").alias("ready"), F.max(F.col("level") + F.col("steps")).alias("level"))
        fresh = stored(of.where("n = ready").select(*key, "level"), "levels")
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
        arms = stored(arms.join(fresh, key, "left_anti"), "arms")
    of_chains = ends.join(at(known, "end"), ["conv_id", "end"], "left").select(*key, (F.col("level") + F.col("steps")).alias("level"))
    found = known.unionByName(of_chains)
    return edges.select(*key).distinct().join(found, key, "left").select(*key, F.coalesce("level", F.lit(-1)).alias("level"))


def linked_calls(conversations: DataFrame) -> DataFrame:
    """Every tool call with its result, level and faults: a row for each call and for each result without one.

    conv_id, id, name, call_turn, call_message, place, level, result_turn, result_message, status, problems.  status is ok,
    no_id, duplicate_id (of equal ids the first by turn and place is linked), no_result, early_result (it stands before
    its call), unknown_tool (the conversation lists tools, but not this), invalid_arguments, unchecked (the schema says
    something that is not read here), cycle, orphan_result or duplicate_result (of several the first by turn is linked).
    """
    messages = _read(conversations)
    calls = _calls(messages)
    results = messages.where("kind = 'tool' and json is not null").select("conv_id", "turn", "message", _get("json", "$.tool_call_id", "string").alias("id")).where("id is not null").dropDuplicates(["message"])
    first_call = calls.where("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "message", "place")).alias("first_call"))
    first_result = results.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "message")).alias("first_result"))
    keyed = lambda left, right, how, keys=("conv_id", "id"): left.alias("l").join(right.select(*[F.col(k).alias(f"{k}_r") for k in keys], *[c for c in right.columns if c not in keys]).alias("r"), F.expr(" and ".join(f"l.{k} <=> r.{k}_r" for k in keys)), how)
    listed = _tools(messages)
    any_tools = listed.select("conv_id").distinct().withColumn("lists_tools", F.lit(True))
    df = keyed(keyed(calls, first_call, "left").drop("conv_id_r", "id_r"), first_result, "left").drop("conv_id_r", "id_r")
    df = keyed(df, listed, "left", ("conv_id", "name")).drop("conv_id_r", "name_r")
    df = keyed(df, any_tools, "left", ("conv_id",)).drop("conv_id_r")
    df = keyed(df, _levels(calls), "left").drop("conv_id_r", "id_r")
    own = (F.struct("turn", "message", "place") == F.col("first_call")) & F.col("id").isNotNull()
    df = df.join(_problems(df.select("message", "place", "arguments", "schema")), ["message", "place"], "left")
    df = df.withColumn("problems", F.coalesce("problems", F.array().cast("array<string>"))).withColumn("level", F.coalesce("level", F.lit(0)))
    status = (
        F.when(F.col("id").isNull(), "no_id").when(~own, "duplicate_id").when(F.col("level") < 0, "cycle")
        .when(F.col("lists_tools") & F.col("known").isNull(), "unknown_tool").when(~F.col("unread"), "invalid_arguments")
        .when(F.col("first_result").isNull(), "no_result").when(F.col("first_result.turn") < F.col("turn"), "early_result").when(F.col("unread"), "unchecked").otherwise("ok")
    )
    linked = F.col("first_result").isNotNull() & own
    made = df.select("conv_id", "id", "name", F.col("turn").alias("call_turn"), F.col("message").alias("call_message"), "place", "level", F.when(linked, F.col("first_result.turn")).alias("result_turn"), F.when(linked, F.col("first_result.message")).alias("result_message"), status.alias("status"), F.array_join("problems", "; ").alias("problems"))
    rest = keyed(keyed(results, first_result, "left").drop("conv_id_r", "id_r"), first_call, "left").drop("conv_id_r", "id_r")
    none = lambda kind: F.lit(None).cast(kind)
    rest = rest.withColumn("status", F.when(F.col("first_call").isNull(), "orphan_result").when(F.struct("turn", "message") != F.col("first_result"), "duplicate_result")).where("status is not null")
    return made.unionByName(rest.select("conv_id", "id", none("string").alias("name"), none("bigint").alias("call_turn"), none("bigint").alias("call_message"), none("int").alias("place"), none("int").alias("level"), F.col("turn").alias("result_turn"), F.col("message").alias("result_message"), "status", F.lit("").alias("problems")))


def format_chat(conversations: DataFrame) -> DataFrame:
    """Every message as canonical JSON, with the places that sort a conversation: a row for each row given.

    conv_id, turn, role, order_turn, order_level, order_place, n_calls, n_linked, status, problems, json.  Sorting a
    conversation by order_turn, order_level and order_place puts every result after its call and calls of one message in
    the order of their dependencies; no task needs a whole conversation for that.  status is ok, or the statuses of the
    message's calls or of its result that are not ok, joined by commas.  Repeated rows come out as often; a null role or
    text counts as empty; text that is no JSON object is plain content; a null conv_id or turn is kept (ids link inside the
    null conversation too).  Of equal keys in one object the last counts.  Strings and digits have no bound of their
    own; JSON that is nested over 1,000 deep, or beyond a variant's size (128 MiB), stays plain content, and the message has
    the status ``unreadable``.  Equal
    numbers have one spelling (RFC 8785's for what a double holds); numbers of more digits than a decimal keep theirs, and
    numbers beyond a double theirs in small letters.  A text that has U+FDD0, U+FDD1 or U+FDD2 keeps a double's spelling.
    Messages are joined by a 64-bit hash of the row: were two of a table's to clash, both would show the calls of both.  An empty table gives an empty
    result; further columns are ignored.
    """
    messages = _read(conversations)
    calls = _calls(messages)
    links = stored(linked_calls(conversations), "links")
    sent = links.where("call_message is not null").select(F.col("call_message").alias("message"), "place", "level", "status", "problems", F.col("result_turn").isNotNull().alias("answered"))
    parts = calls.select("message", "place", F.expr(_json("struct(arguments, id, name)")).alias("text")).join(sent, ["message", "place"])
    # the calls of one message alone come together
    of_calls = parts.groupBy("message").agg(
        F.array_sort(F.collect_list(F.struct(F.when(F.col("level") < 0, _LAST).otherwise(F.col("level")).alias("level"), "place", "text"))).alias("list"),
        F.count("*").alias("n_calls"), F.count_if("answered").alias("n_linked"),
        F.array_sort(F.collect_set(F.when(F.col("status") != "ok", F.col("status")))).alias("states"), F.array_sort(F.collect_set(F.when(F.col("problems") != "", F.concat_ws(": ", F.col("place").cast("string"), "problems")))).alias("faults"),
    )
    got = links.where("result_message is not null").groupBy(F.col("result_message").alias("message")).agg(F.min(F.struct(F.when(F.col("call_message").isNull(), 1).otherwise(0).alias("alone"), "call_turn", "level", "place", "status", "result_turn", "id")).alias("call"))
    df = messages.join(of_calls, "message", "left").join(got, "message", "left")
    is_result = F.col("call").isNotNull()
    df = df.withColumn("content", _get("json", "$.content", "variant"))
    content = F.col("content")
    plain = F.to_json(F.struct(F.col("text").alias("content"), F.coalesce("role", F.lit("")).alias("role")))
    as_calls = F.concat(F.lit("{"), F.when(content.isNotNull(), F.concat(F.lit('"content":'), F.expr(_json("content")), F.lit(","))).otherwise(""), F.lit('"role":'), F.expr("to_json(cast(role as variant))"), F.lit(',"tool_calls":['), F.array_join(F.transform("list", lambda x: x["text"]), ","), F.lit("]}"))
    as_result = F.concat(F.lit("{"), F.when(content.isNotNull(), F.concat(F.lit('"content":'), F.expr(_json("content")), F.lit(","))).otherwise(""), F.lit('"role":'), F.expr("to_json(cast(role as variant))"), F.lit(',"tool_call_id":'), F.expr("to_json(cast(call.id as variant))"), F.lit("}"))
    tools = F.when((F.col("kind") == "system") & _get("json", "$.tools", "array<variant>").isNotNull(), F.concat(F.lit('{"content":'), F.expr(_json("json")), F.lit(',"role":'), F.expr("to_json(cast(role as variant))"), F.lit("}")))
    return df.select(
        "conv_id", "turn", "role",
        F.when(is_result, F.greatest("turn", "call.call_turn")).otherwise(F.col("turn")).alias("order_turn"),
        F.when(is_result, F.coalesce("call.level", F.lit(0)) + 1).otherwise(F.lit(0)).alias("order_level"),
        F.when(is_result, F.coalesce("call.place", F.lit(0))).otherwise(F.lit(0)).alias("order_place"),
        F.coalesce("n_calls", F.lit(0)).cast("bigint").alias("n_calls"),
        F.coalesce("n_linked", F.when(is_result & (F.col("call.alone") == 0), F.lit(1)), F.lit(0)).cast("bigint").alias("n_linked"),
        F.when(F.size("states") > 0, F.array_join("states", ",")).when(is_result & (F.col("call.alone") == 1), F.col("call.status")).when(is_result & (F.col("call.status") == "early_result"), F.lit("early_result")).when(F.col("unreadable"), F.lit("unreadable")).otherwise(F.lit("ok")).alias("status"),
        F.coalesce(F.array_join("faults", "; "), F.lit("")).alias("problems"),
        F.coalesce(F.when(F.col("list").isNotNull(), as_calls), F.when(is_result, as_result), tools, plain).alias("json"),
    )
