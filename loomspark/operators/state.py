"""Session state: entities, decisions, topics, actions, summaries, handoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js, like

# --- fixed values -------------------------------------------------------------
FILES = r"\b([\w\/.-]+\.(?:ts|js|py|rs|go|java|json|yaml|yml|md|toml|sql|css|html))\b"
TOOLS = r"(?i)\b(?:docker|kubernetes|k8s|git|npm|yarn|pnpm|pip|cargo|eslint|prettier|webpack|vite|jest|vitest|mocha|terraform|ansible|helm)\b"
PERSONS = r"\b(?:Peter|Friday|Jarvis|EDITH|Alice|Bob)\b"
CONCEPTS = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
DECISIONS = (r"(?i)\b(?:decided|decide|decision|agreed|settled on|went with|chose|chosen|selected|opted for|will use|going to use)\b[^.!?]*", r"(?i)\b(?:let's|lets|we'll|we will|should)\s+(?:go with|use|do|try|implement|adopt|switch to)\b[^.!?]*")
ACTIONS = (("code", r"(?i)\b(?:wrote|written|coded|implemented|refactored|fixed|patched|built|compiled)\b"), ("config", r"(?i)\b(?:configured|setup|set up|installed|updated|upgraded|changed.*config)\b"), ("deploy", r"(?i)\b(?:deployed|released|shipped|pushed|launched|published)\b"), ("review", r"(?i)\b(?:reviewed|checked|inspected|audited|examined)\b"), ("test", r"(?i)\b(?:tested|ran tests|verified|validated)\b"), ("discuss", r"(?i)\b(?:discussed|talked about|chatted|met about|conferred)\b"))
TOPIC_TAGS = "authentication,auth,deployment,deploy,database,api,frontend,backend,testing,test,bug,fix,performance,security,configuration,config,migration,refactoring,refactor,documentation,docs,monitoring,logging,error handling,ci/cd,pipeline,docker,kubernetes,compression,drift,context,memory,token,budget,plugin,gateway,session,state".split(",")
STOP = "the a an is are was were to of in for on with at by from as that this it be has have do does did will would can could should may might shall not no yes but or and if so about just like get got use used using make made want need know think see say let way also well even still already yet".split()
IDENT = r"\b(?:[A-Z]{2,}-\d+|#\d+|[0-9a-f]{7,40})\b"
# ------------------------------------------------------------------------------


def _matches(messages: DataFrame, pattern: str, group: int, by: list[str], idx: str, text: str) -> DataFrame:
    found = F.regexp_extract_all(text, F.lit(js(pattern)), F.lit(group))
    return messages.select(*by, idx, F.posexplode(found).alias("pos", "value"))


def _ranked(messages: DataFrame, patterns, by: list[str], idx: str, text: str) -> DataFrame:
    """(by..., idx, rank, pos, value): matches of several (pattern, group) out of one reading of the messages; rank is the pattern's place."""
    of = lambda rank, p, group: F.transform(F.regexp_extract_all(text, F.lit(js(p)), F.lit(group)), lambda v, i: F.struct(F.lit(rank).alias("rank"), i.alias("pos"), v.alias("value")))
    found = F.explode_outer(F.concat(*[of(rank, p, group) for rank, (p, group) in enumerate(patterns)])).alias("_m")
    return messages.select(*by, idx, found).filter("_m is not null").select(*by, idx, "_m.rank", "_m.pos", "_m.value")


def typed_entities(messages: DataFrame, by: list[str], idx: str = "idx", text: str = "content") -> DataFrame:
    """(by..., key, name, type, mentions); the first type that names an entity holds, files before tools, persons and concepts."""
    kinds = ("file", "tool", "person", "concept")
    out = _ranked(messages, ((FILES, 1), (TOOLS, 0), (PERSONS, 0), (CONCEPTS, 1)), by, idx, text).withColumn("type", F.element_at(F.array(*map(F.lit, kinds)), F.col("rank") + 1))
    g = out.groupBy(*by, F.lower("value").alias("key")).agg(F.count(F.lit(1)).alias("mentions"), F.min_by(F.struct("value", "type"), F.struct("rank", idx, "pos")).alias("f"))
    return g.select(*by, "key", F.col("f.value").alias("name"), F.col("f.type").alias("type"), "mentions")


def by_type(entities: DataFrame, by: list[str]) -> DataFrame:
    """Number of entities of each type."""
    return entities.groupBy(*by).agg(*[F.count_if(F.col("type") == t).alias(t) for t in ("file", "tool", "person", "concept")])


def actor(s: Column) -> Column:
    return F.when(like(s, r"(?i)\b(I|me|my)\b"), "user").when(like(s, r"(?i)\b(we|our|us|let's|lets)\b"), "team").when(like(s, r"(?i)\b(AI|assistant|agent|EDITH|Jarvis|Friday)\b"), "agent").otherwise("unknown")


def decisions(messages: DataFrame, by: list[str], idx: str = "idx", text: str = "content") -> DataFrame:
    """Distinct decisions with actor and confidence."""
    out = _ranked(messages, [(p, 0) for p in DECISIONS], by, idx, text).withColumn("value", F.trim("value")).filter(F.char_length("value") >= 10)
    g = out.groupBy(*by, F.lower("value").alias("key")).agg(F.min_by("value", F.struct("rank", idx, "pos")).alias("description"))
    s, n = F.col("description"), F.char_length("description")
    conf = F.lit(5) + (n > 20).cast("int") + (n > 50).cast("int") + F.when(like(s, r"(?i)\b(decided|agreed|chose|selected|will use)\b"), 2).otherwise(0) + F.when(like(s, r"(?i)\b(because|since|due to|for the reason)\b"), 1).otherwise(0)
    return g.select(*by, "key", "description", actor(s).alias("actor"), F.least(F.lit(1.0), conf / 10.0).alias("confidence"))


def topic_tags(messages: DataFrame, by: list[str], text: str = "content", most: int = 10) -> DataFrame:
    """(by..., label, weight): counts of listed words over the largest, the best ten."""
    counts = F.array(*[F.struct(F.lit(k).alias("label"), F.regexp_count(F.lower(text), F.lit(js(rf"\b{k}\b"))).alias("n"), F.lit(i).alias("place")) for i, k in enumerate(TOPIC_TAGS)])
    x = messages.select(*by, F.explode(F.filter(counts, lambda c: c["n"] > 0)).alias("c")).groupBy(*by, "c.label", "c.place").agg(F.sum("c.n").alias("n"))
    w = Window.partitionBy(*by)
    x = x.withColumn("weight", F.col("n") / F.max("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "place")))
    return x.filter(F.col("r") <= most).select(*by, "label", "weight")


def actions(messages: DataFrame, by: list[str], idx: str = "idx", text: str = "content") -> DataFrame:
    """I8: every match of an action verb with its class."""
    out = None
    for kind, p in ACTIONS:
        x = _matches(messages, p, 0, by, idx, text).select(*by, idx, F.lit(kind).alias("type"), F.trim("value").alias("description"))
        out = x if out is None else out.unionByName(x)
    return out


def merge_entities(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Mentions summed, the earlier state's name and type kept."""
    x = a.withColumn("_s", F.lit(0)).unionByName(b.withColumn("_s", F.lit(1)))
    return x.groupBy(*by, "key").agg(F.min_by(F.struct("name", "type"), "_s").alias("f"), F.sum("mentions").alias("mentions")).select(*by, "key", "f.name", "f.type", "mentions")


def merge_decisions(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The earlier state's decisions and those of the later one that are new."""
    return a.unionByName(b.join(a.select(*by, "key"), [*by, "key"], "left_anti"))


def theme_keywords(messages: DataFrame, by: list[str], text: str = "content", most: int = 5) -> DataFrame:
    """(by..., word, n): latin words of three letters and more and pairs of CJK characters; twice at least unless the session has CJK.

    Each text is read once for its words and once for its CJK characters, whatever their number: what is taken apart
    inside a lambda would be taken apart again for each of them.
    """
    latin = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.char_length(w) >= 3)
    chars = F.regexp_extract_all(text, F.lit("[\\u4e00-\\u9fff\\u3400-\\u4dbf\\uf900-\\ufaff]"), F.lit(0))
    # shifted by one, the last place has no second character and gives null; "" stands for the CJK of a text
    pairs = F.zip_with(chars, F.slice(F.concat(chars, F.array(F.lit(None).cast("string"))), F.lit(2), F.size(chars)), lambda a, b: F.concat(a, b))
    mark = F.when(F.size(chars) > 0, F.array(F.lit(""))).otherwise(F.expr("cast(array() as array<string>)"))
    x = messages.select(*by, F.explode_outer(F.concat(latin, pairs, mark)).alias("word")).filter(F.col("word").isNotNull() & ~F.col("word").isin(STOP))
    g = x.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    g = g.withColumn("any_cjk", F.max(F.col("word") == "").over(w)).filter("word <> ''")
    # rarer words come last, so that the best are the same with and without them
    g = g.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "word"))).filter((F.col("r") <= most) & (F.col("any_cjk") | (F.col("n") >= 2)))
    return g.select(*by, "word", "n")


def summaries(messages: DataFrame, by: list[str]) -> DataFrame:
    """Theme, task lines, key decisions and top entities of each session with a message."""
    return _summaries(messages, by).drop("_said")


def _summaries(messages: DataFrame, by: list[str]) -> DataFrame:
    """``summaries`` and the number of messages that are not blank."""
    theme = theme_keywords(messages, by).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "word"))), lambda x: x["word"]), ", ").alias("theme"))
    listed = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("description"))))
    dec = decisions(messages, by).groupBy(*by).agg(listed(F.col("actor").isin("user", "team") & (F.col("confidence") >= 0.6)).alias("tasks"), listed(F.col("confidence") >= 0.7).alias("points"))
    ent = typed_entities(messages, by).groupBy(*by).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("mentions")).alias("k"), "key", "name"))), 1, 5), lambda x: x["name"]).alias("entities"))
    base = messages.groupBy(*by).agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(F.trim("content") != "").alias("_said"))
    out = base.join(theme, by, "left").join(dec, by, "left").join(ent, by, "left")
    empty = F.expr("cast(array() as array<string>)")
    return out.select(*by, "n_messages", "_said", F.coalesce("theme", F.lit("General discussion")).alias("theme"), *[F.coalesce(c, empty).alias(c) for c in ("tasks", "points", "entities")])


def handoff(messages: DataFrame, by: list[str], idx: str = "idx", text: str = "content", most: int = 20) -> DataFrame:
    """(by..., kind, value, rank): files and ids from the newest message back, each at its newest place, 20 of a kind at most."""
    x = _matches(messages, FILES, 1, by, idx, text).withColumn("kind", F.lit("file")).unionByName(_matches(messages, IDENT, 0, by, idx, text).withColumn("kind", F.lit("id")))
    g = x.groupBy(*by, "kind", "value").agg(F.min(F.struct((-F.col(idx)).alias("i"), "pos")).alias("at"))
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "kind").orderBy("at")))
    return g.filter(F.col("rank") <= most).select(*by, "kind", "value", "rank")


def handoff_record(messages: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """A JSON record for each session of ``least`` messages and more: its summary and the last three user messages, 300 characters each."""
    last = messages.filter("role = 'user'").withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("idx")))).filter("_r <= 3")
    last = last.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.substring("content", 1, 300).alias("t")))), lambda x: x["t"]).alias("recent_user_messages"))
    x = _summaries(messages, by).filter(F.col("_said") >= least).join(last, by, "left")
    return x.select(*by, F.to_json(F.struct("theme", "tasks", "points", "entities", "n_messages", "recent_user_messages")).alias("record"))
