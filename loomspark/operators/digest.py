"""Structural digest: facts, rejected approaches, pitfalls, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, js, like

# --- fixed values -------------------------------------------------------------
CONFIRMED = (
    r"(?i)\b(?:decided|agreed|settled on|went with|chose|chosen|selected|opted for|will use)\b",
    r"(?:决定|同意|确认|选定|采用|一致认为)",
    r"确定(?:使用|用|方案|采用)",
)
CONFIRMED_WEAK = (
    r"(?i)\b(?:should|let's|we'll)\s+(?:go with|use|do|try|implement|adopt|switch to)\b",
    r"(?i)\b(?:plan|planning|thinking) to (?:use|try|implement|adopt|switch to)\b",
    r"(?:建议|考虑|打算)(?:用|采用|试|换|切换)",
    r"可以(?:试试|试一下|用)",
)
SUPPRESS = (
    r"(?i)\b(?:maybe|perhaps|probably|possibly|should we|can we|how about|what about|do you think|could try|would be nice)\b",
    r"(?:也许|可能|或许|大概|要不要|怎么样|是不是|能不能|要不)",
)
REJECTED = (
    r"(?i)\b(?:rejected|abandoned|abandon|scrapped|dropped|decided against|backed out of)\b",
    r"(?i)\b(?:does|do|did|will|won't|wont|would) not work\b|\bdoesn't work\b|\bdidn't work\b",
    r"(?i)\bnot (?:viable|feasible|an option|worth it)\b",
    r"(?i)\bno longer (?:using|needed|required|an option|feasible)\b",
    r"(?i)\bremoved the (?:approach|solution|option|idea)\b",
    r"(?:否决|放弃|回退|撤掉|废弃|弃用)",
    r"(?:行不通|不可行|不采用|不成立|跑不通|走不通|被拒)",
    r"(?:没(?:有)?成功|试(?:了|过)不行|别再?用)",
)
LINKER = r"(?i)\b(?:because|due to|as a result|in order to|so that)\b|(?:因为|由于|目的是|以便|从而|所以)"
REASON = r"(?i)\b(?:because|due to)\b|(?:因为|由于|原因是|是因为)"
NEGATIVE = (
    r"(?i)\b(?:error|errors|fails?|failed|crash(?:es|ed)?|broken|throws?|threw|rejected|invalid|deprecated|gotcha|pitfalls?|misbehav(?:es|ed))\b|\bnot (?:supported|available|working)\b|\breturns? (?:null|undefined)\b"
    r"|(?:报错|出错|失败|崩溃|崩了|坑|陷阱|注意|小心|无法|不能|无效|被拒|拒绝|不支持|不兼容|踩(?:过|坑)|失效|异常)"
)
PENDING = r"(?i)\b(?:todo|pending|next step|follow[- ]?up|need to|not yet|remaining|outstanding)\b"
SYMBOL = r"\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)"
TICKED = r"`([\w./@:-]+)`"
WORKAROUND = r"(?i)\bworkarounds?\s*[:：]?\s*([^.;，。]+)"
WORKAROUND_CJK = r"(?:绕开|解决办法|替代方案|改用)\s*(?:[:：]?\s*)?([^.;，。]+)"
#: What ends a sentence, before white space.
SENTENCE_END = "[.!?。！？]"
# ------------------------------------------------------------------------------


def sentences(messages: DataFrame, text: str = "content") -> DataFrame:
    """One row for each sentence with its place; sentences end behind . ! ? and white space, or at a line's end."""
    marked = F.regexp_replace(F.regexp_replace(F.col(text), rf"({SENTENCE_END})\s+", "$1\n"), r"\n+", "\n")
    return messages.select("*", F.posexplode(F.split(marked, "\n")).alias("pos", "sentence")).withColumn("sentence", F.trim("sentence")).filter("sentence <> ''")


def actor(s: Column) -> Column:
    return F.when(like(s, r"(?i)\b(I|me|my)\b"), "user").when(like(s, r"(?i)\b(AI|assistant|agent|Jarvis|EDITH|Friday)\b"), "agent").when(like(s, r"(?i)\b(we|our|us|let's|lets)\b"), "team").otherwise("unknown")


def confirmed(sents: DataFrame) -> DataFrame:
    """I16: facts with confidence: strong signs from 0.85, weak ones 0.75 if a reason is given and nothing takes them back."""
    s = F.col("sentence")
    strong, weak = any_of(s, CONFIRMED), any_of(s, CONFIRMED_WEAK)
    link = F.when(like(s, LINKER), 0.1).otherwise(0.0)
    c = F.when(strong, F.least(F.lit(0.95), F.floor((0.85 + link + F.when(F.char_length(s) > 50, 0.05).otherwise(0.0)) * 100 + 0.5) / 100)).when(weak & ~any_of(s, SUPPRESS) & like(s, LINKER), 0.75)
    return sents.withColumn("confidence", c).filter(F.col("confidence").isNotNull() & ~s.endswith("?") & (F.char_length(s) >= 12)).withColumn("actor", actor(s))


def rejected(sents: DataFrame) -> DataFrame:
    """Approach and reason, parted at the first reason word."""
    s = F.col("sentence")
    at = F.regexp_instr(s, F.lit(js(REASON)))
    word = F.regexp_substr(s, F.lit(js(REASON)))
    head = F.when(at > 1, F.regexp_replace(F.trim(F.expr("substring(sentence, 1, _at - 1)")), r"[,;:]\s*$", "")).otherwise(s)
    tail = F.when(at > 1, F.trim(F.expr("substring(sentence, _at + char_length(_word))"))).otherwise("")
    x = sents.filter(any_of(s, REJECTED)).withColumns({"_at": at, "_word": word})
    return x.withColumns({"approach": F.substring(head, 1, 300), "reason": F.substring(tail, 1, 300)}).drop("_at", "_word")


def pitfalls(sents: DataFrame) -> DataFrame:
    """Api symbol and workaround of sentences that name a failure."""
    s = F.col("sentence")
    dotted, ticked = F.regexp_extract(s, js(SYMBOL), 1), F.regexp_extract(s, js(TICKED), 1)
    symbol = F.when(dotted != "", dotted).when(ticked != "", ticked)
    return sents.filter(like(s, NEGATIVE)).withColumn("symbol", symbol).filter(F.col("symbol").isNotNull()).withColumn("workaround", F.trim(F.coalesce(F.nullif(F.regexp_extract(s, js(WORKAROUND), 1), F.lit("")), F.regexp_extract(s, WORKAROUND_CJK, 1))))


def claims(sents: DataFrame, by: list[str], order: list[str], most: int = 20) -> DataFrame:
    """The strongest sentence of each message, the ``most`` strongest of a session in the order of the source."""
    s = F.col("sentence")
    base = F.greatest(F.when(any_of(s, REJECTED), 3).otherwise(0), F.when(like(s, NEGATIVE), 2).otherwise(0), F.when(like(s, PENDING), 3).otherwise(0), F.when(any_of(s, CONFIRMED), 2).otherwise(0))
    ident = F.when(like(s, SYMBOL) | like(s, TICKED), 1).otherwise(0)
    x = sents.withColumn("strength", base + ident).filter("strength > 0")
    x = x.withColumn("_best", F.row_number().over(Window.partitionBy(*by, *order).orderBy(F.desc("strength"), "pos"))).filter("_best = 1")
    x = x.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("strength"), *order))).filter(F.col("_rank") <= most)
    conf = F.when(F.col("strength") >= 4, 0.9).when(F.col("strength") == 3, 0.8).when(F.col("strength") == 2, 0.6).otherwise(0.4)
    return x.withColumn("confidence", conf).withColumn("span", F.substring(s, 1, 512)).drop("_best", "_rank")


def valid_claims(found: DataFrame, messages: DataFrame, by: list[str]) -> DataFrame:
    """Claims whose span is a part of the message they name."""
    m = messages.select(*by, F.col("content").alias("_content"))
    return found.join(m, by).filter(F.contains("_content", F.col("span"))).drop("_content")


def last_n(df: DataFrame, by: list[str], order: list[Column], n: int = 60) -> DataFrame:
    """The last n rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def serialize(entries: DataFrame, by: list[str]) -> DataFrame:
    """One text for each session: a head line and a line for each entry (kind, text, confidence), by kind and place."""
    line = F.concat(F.lit("- ["), F.col("kind"), F.lit("] "), F.col("text"), F.lit(" ("), F.format_string("%.2f", F.col("confidence")), F.lit(")"))
    g = entries.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("kind", "seq", line.alias("line")))).alias("l"))
    return g.select(*by, F.concat(F.lit("[Structural Digest v2]\n"), F.array_join(F.transform("l", lambda r: r["line"]), "\n")).alias("digest"))


def parse(digests: DataFrame, by: list[str], text: str = "digest") -> DataFrame:
    """The entries of a digest text."""
    x = digests.select(*by, F.posexplode(F.split(text, "\n")).alias("seq", "line")).filter(F.col("line").startswith("- ["))
    part = lambda i: F.regexp_extract("line", r"^- \[(\w+)\] (.*) \((\d\.\d\d)\)$", i)
    return x.select(*by, "seq", part(1).alias("kind"), part(2).alias("text"), part(3).cast("double").alias("confidence"))


def newest_digest(entries: DataFrame, by: list[str], idx: str = "idx", text: str = "content", prefix: str = "[Structural Digest") -> tuple[DataFrame, DataFrame]:
    """The newest digest entry of each session, and the entries that are none."""
    is_digest = F.col(text).startswith(prefix)
    return entries.filter(is_digest).groupBy(*by).agg(F.max_by(text, idx).alias("digest"), F.max(idx).alias(idx)), entries.filter(~is_digest)
