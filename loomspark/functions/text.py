"""Text expressions: token counts, normalization, keyword features, classifiers (B, C2-C6, I, J)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CJK = "[\\u4e00-\\u9fff\\u3400-\\u4dbf\\uf900-\\ufaff]"
CODE = (r"\b(function|class|interface|type|const|let|var|import|export|async|await)\b", r"```[\s\S]*?```", r"`[^`]+`", r"(?i)\b(?:ts|js|py|go|rs|java|json|yaml|sql|sh)\b")
DECISION = (r"(?i)\b(decided?|decision|choose|chosen|agreed|confirmed?|approved?|finalized?|settled?)\b", r"(?i)\b(will|going to|should|must|need to)\s+\w+", r"(?i)\b(action item|next step|todo|plan|approach|strategy)\b", r"\b(done|completed?|resolved?|fixed?)\b")
ENTITY = (r"(?i)\b(?:gateway|plugin|edith|friday|jarvis)\b", r"\bv?\d+\.\d+\.\d+\b", r"\b(?:https?://|www\.)[^\s]+", r"\b(?:[A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", r"\b(?:[\w.-]+\.(?:ts|js|py|json|md|yml|yaml))\b")
QUESTION = (r"(?m)\?$", r"(?i)\b(what|how|why|when|where|who|which|could you|can you|would you|please)\b.*\?")
TOPICS = ("code", "bug", "fix", "deploy", "test", "refactor", "build", "config", "error", "performance", "api", "database", "task", "version", "release", "review", "compile", "compact", "compaction", "context", "token", "memory", "session", "plugin", "gateway", "TypeScript", "integration", "verification", "design", "architecture")
STATE_WORDS = ("decided", "decision", "resolved", "fixed", "root cause", "blocked", "error", "failed", "regression", "breaking", "depends on", "invariant")
ACTION_WORDS = ("next step", "next action", "todo", "follow-up", "will ", "should ", "plan to", "continue", "run ", "deploy", "verify")
IMPORTANCE = ((r"(?i)\b(important|critical|essential|key|vital|crucial)\b", 0.3), (r"(?i)\b(must|should|required|necessary|mandatory)\b", 0.25), (r"(?i)\b(error|bug|fix|broken|issue|problem)\b", 0.2), (r"(?i)\b(architecture|design|pattern|structure)\b", 0.15), (r"(?i)\b(task|TODO|action|next|step|plan)\b", 0.15), (r"(?i)\b(decision|choose|select|prefer|preference)\b", 0.2), (r"(?i)\b(code|function|class|module|API|endpoint)\b", 0.1))
TASK = {
    "coding": (r"(?i)\b(code|coding|program|implement|bug|fix|deploy|build|compile|test|refactor|function|class|module|import|export|interface|type|api|endpoint|database|sql|schema|migration|docker|kubernetes|ci|cd|pipeline|git|commit|branch|merge|pull request)\b", r"\.(ts|js|py|rs|go|java|cpp|json|yaml|yml|toml|sql)\b", r"(?i)\b(npm|yarn|pnpm|cargo|pip|maven|gradle)\b"),
    "reasoning": (r"(?i)\b(why|analyze|analysis|reason|logic|problem|solution|hypothes|evaluate|assess|compare|contrast|diagnose|root cause|trade.off|decision)\b", r"(?i)\b(think about|consider|pros.*cons|what if|how would)\b"),
    "writing": (r"(?i)\b(write|document|article|blog|content|draft|edit|revise|proofread|summary|summarize|README|changelog|release note)\b", r"\.(md|txt|rst|adoc)\b"),
    "conversation": (r"(?i)\b(hi|hello|hey|how are you|thanks|thank you|bye|goodbye|what's up|sup)\b", r"(?i)\b(chat|talk|discuss)\b"),
}
PROMPT_TASK = ((r"\b(refactor|rewrite|restructure)\b", "refactoring"), (r"\b(test|coverage|spec|assert)\b", "testing"), (r"\b(deploy|release|publish|ship)\b", "deployment"), (r"\b(security|vulnerability|threat|exploit)\b", "security-audit"), (r"\b(architecture|design|structure|pattern)\b", "architecture-design"), (r"\b(document|readme|changelog|comment)\b", "documentation"), (r"\b(create|generate|implement|write|build|develop)\b", "code-generation"), (r"\b(analyze|investigate|profile|benchmark)\b", "data-analysis"), (r"\b(what|how|why|when|where|explain|summarize)\b", "quick-answer"))
PROMPT_TASK_UNGROUPED = ((r"\bfix\b|\bbug\b|\berror\b|\bdebug\b|\btroubleshoot\b", "code-debugging"), (r"\breview\b|\binspect\b|\baudit\b", "code-review"))
ADAPTIVE_TASK = (
    ("review", ("review", "check", "audit", "inspect", "examine"), 1.0),
    ("debugging", ("debug", "fix bug", "error", "crash", "broken", "issue", "trace", "stack trace", "exception", "what caused", "why did"), 1.0),
    ("planning", ("plan", "design", "architect", "roadmap", "strategy", "trade-off", "tradeoff", "architecture", "component", "decision"), 1.0),
    ("question", ("how to", "what is", "explain", "why", "when should"), 0.8),
    ("conversation", ("discuss", "talk about", "opinion", "thoughts"), 0.7),
)
COMPLEX = (r"(?i)\b(complex|multiple|several|various|dependencies|trade-off|optimize|scale|architecture)\b", 0.2), (r"(?i)\b(function|class|module|API|endpoint|database|query|async|concurrent)\b", 0.15), (r"(?i)\b(first|then|next|finally|after that|step)\b", 0.15)
LOW_CONFIDENCE = (r"(?i)\bI think\b", r"(?i)\bI believe\b", r"(?i)\bperhaps\b", r"(?i)\bmaybe\b", r"(?i)\bnot sure\b", r"(?i)\bunclear\b", r"(?i)\bpossibly\b", r"(?i)\bprobably\b", r"(?i)\bmight be\b")
SANITIZE = ((r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z?", "[timestamp]"), (r"\bmsg-\d+\b", "[msg]"), (r"\bturn \d+\b", "[turn]"), (r"\b\d{13,}\b", "[number]"))
# ----------------------------------------------------------------------------


def round2(x: Column) -> Column:
    """Half up, to two places."""
    return F.floor(x * 100 + 0.5) / 100


def cjk_chars(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, CJK, ""))


def heuristic_tokens(text: Column) -> Column:
    """max(1, ceil((1.5 cjk + 0.25 other) * 1.1)), 0 for empty."""
    raw = (cjk_chars(text) * 1.5 + (F.char_length(text) - cjk_chars(text)) * 0.25) * 1.1
    return F.when(F.coalesce(F.char_length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(raw))).cast("long")


def heuristic_accuracy(text: Column) -> Column:
    """C3."""
    n = F.char_length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.85).otherwise(0.8 + 0.15 * cjk_chars(text) / n)


def signal_tokens(text: Column) -> Column:
    """C4: one for a CJK character, 1 / 3.5 for another, rounded up."""
    cjk = F.char_length(text) - F.char_length(F.regexp_replace(text, "[\\u4e00-\\u9fff\\u3400-\\u4dbf]", ""))
    return F.ceil(cjk + (F.char_length(text) - cjk) / 3.5).cast("long")


def rough_tokens(text: Column) -> Column:
    """C5."""
    return F.ceil(F.char_length(text) / 4).cast("long")


_W = "[A-Za-z0-9_]"


def _words_only(group: str) -> tuple[bool, bool]:
    """Whether all alternatives of a group's inside begin, and end, with a word character."""
    parts = re.sub(r"\([^()]*\)", "x", group).split("|")
    return all(re.match(_W, a) for a in parts), all(re.search(rf"{_W}(?:{_W}\?)?$", a) for a in parts)


def js(pattern: str) -> str:
    """The pattern with word boundaries of ASCII letters, digits and underscore; the JVM's own take in all scripts.

    Around a group of words a look to one side is enough.
    """
    m = re.fullmatch(r"(\(\?i\))?\\b\((\?:)?([^()]*)\)\\b", pattern)
    if m and _words_only(m[3]) == (True, True):
        return f"{m[1] or ''}(?<!{_W})({m[2] or ''}{m[3]})(?!{_W})"
    return pattern.replace(r"\b", f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))")


def like(text: Column, pattern: str) -> Column:
    return text.rlike(js(pattern))


def any_of(text: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | like(text, p)
    return out


def has_words(text: Column, words) -> Column:
    """Any of the words as a substring of the lower-cased text."""
    low, out = F.lower(text), F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def importance(text: Column) -> Column:
    """I1 without the duplicate penalty: 0 below five characters, else the sum of the boosts."""
    s = sum((F.when(any_of(text, p), b).otherwise(0) for p, b in ((CODE, 30), (DECISION, 25), (ENTITY, 20), (QUESTION, 15))), F.lit(0))
    return F.when(F.char_length(text) < 5, 0).otherwise(s)


def factors(text: Column) -> Column:
    """Names of the boosts that apply."""
    named = (("code", CODE), ("decision", DECISION), ("entity", ENTITY), ("question", QUESTION))
    return F.when(F.char_length(text) < 5, F.array(F.lit("empty"))).otherwise(F.filter(F.array(*[F.when(any_of(text, p), F.lit(n)) for n, p in named]), lambda x: x.isNotNull()))


def entities(text: Column) -> Column:
    """I2 for one message: matches of the patterns in order, lower-cased, distinct."""
    return F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(text, F.lit(js(p)), F.lit(0)) for p in ENTITY]), F.lower))


def decision_sentences(text: Column, least: int = 10, most: int = 150) -> Column:
    """I3 for one message: sentences with a decision mark, trimmed and cut."""
    parts = F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s))
    return F.transform(F.filter(parts, lambda s: any_of(s, DECISION) & (F.char_length(s) > least)), lambda s: F.substring(s, 1, most))


def topics(text: Column) -> Column:
    """I4 for one message: the listed keywords that occur as substrings, in the list's order."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(t) for t in TOPICS]), lambda t: F.contains(low, F.lower(t)))


def long_words(text: Column, more_than: int = 3) -> Column:
    """Distinct lower-cased words of more than so many characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.char_length(w) > more_than))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def position_importance(text: Column) -> Column:
    """I24."""
    s = F.lit(0.0)
    for p, w in IMPORTANCE:
        s = s + F.least(F.lit(3 * w), F.regexp_count(text, F.lit(js(p))) * w)
    n = F.char_length(text)
    s = s + F.when((n > 100) & (n < 2000), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), round2(s))


def task_scores(text: Column) -> dict[str, Column]:
    """Every pattern that matches adds its match and its group: two, or one without a group."""
    return {t: sum((F.when(like(text, p), 2).otherwise(0) for p in ps), F.lit(0)) for t, ps in TASK.items()}


def task_type(text: Column) -> Column:
    """The class of the best score, the first of equals, unknown below two."""
    scores = task_scores(text)
    best = F.greatest(*scores.values())
    out = F.lit("unknown")
    for t, s in reversed(scores.items()):
        out = F.when(s == best, t).otherwise(out)
    return F.when(best < 2, "unknown").otherwise(out)


def task_confidence(text: Column) -> Column:
    """The best score's share of all."""
    scores = list(task_scores(text).values())
    total = sum(scores[1:], scores[0])
    return F.when(total == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(*scores) / total))


def adaptive_task(text: Column) -> Column:
    """Struct of type and confidence; the first of equals wins."""
    low, kind, conf = F.lower(text), F.lit("unknown"), F.lit(0.0)
    for name, words, weight in ADAPTIVE_TASK:
        hits = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
        c = F.least(F.lit(0.95), hits * 0.25 * weight)
        kind, conf = F.when(c > conf, name).otherwise(kind), F.greatest(conf, c)
    return F.struct(kind.alias("type"), conf.alias("confidence"))


def prompt_task(text: Column) -> Column:
    """The first pattern with a group that matches, else the first without, else quick-answer."""
    low = F.lower(text)
    out = F.lit("quick-answer")
    for p, t in reversed(PROMPT_TASK_UNGROUPED):
        out = F.when(like(low, p), t).otherwise(out)
    for p, t in reversed(PROMPT_TASK):
        out = F.when(like(low, p), t).otherwise(out)
    return out


def complexity(text: Column) -> Column:
    """J6."""
    n = F.char_length(text)
    s = F.when(n > 500, 0.3).when(n > 200, 0.15).otherwise(0.0)
    m = F.size(F.filter(F.split(text, "[.!?]+"), lambda x: F.char_length(F.trim(x)) > 10))
    s = s + F.when(m > 5, 0.2).when(m > 2, 0.1).otherwise(0.0)
    for p, w in COMPLEX:
        s = s + F.when(like(text, p), w).otherwise(0.0)
    return F.least(F.lit(1.0), round2(s))


def sanitize(text: Column) -> Column:
    """Volatile parts of a text replaced by marks."""
    for p, r in SANITIZE:
        text = F.regexp_replace(text, js(p), r)
    return text


def session_hash(session: Column) -> Column:
    """The first eight characters, filled up with zeros."""
    return F.rpad(F.substring(session.cast("string"), 1, 8), 8, "0")


def lineage_ids(ids: Column, most: int = 50) -> Column:
    """Trimmed, non-empty, distinct ids in order, at most so many."""
    return F.slice(F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != "")), 1, most)


def structured_kind(text: Column) -> Column:
    """Json, csv, table, sql-result, kg or null."""
    t = F.trim(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    commas = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(","), F.lit("")))
    first = commas(F.get(lines, F.lit(0)))
    csv = (F.size(lines) >= 2) & (first > 0) & F.forall(F.slice(lines, 2, 4), lambda x: commas(x) == first)
    return (
        F.when(t == "", None).when(t.rlike(r"^[\{\[]") & F.try_parse_json(t).isNotNull(), "json").when(csv, "csv")
        .when(t.rlike(r"\|.*\|") & t.rlike(r"\|[-:\s|]+\|"), "table").when(like(t, r"(?i)^(SELECT|INSERT|UPDATE|DELETE|CREATE)\b"), "sql-result")
        .when(like(t, r"(?i)\b\w+\s+(is|has|contains|relates|connected)\s+\w+"), "kg")
    )


def media_refs(text: Column) -> Column:
    """http(s) urls with the kind their extension tells."""
    urls = F.regexp_extract_all(text, F.lit(r"https?://[^\s\"'<>)]+"), F.lit(0))
    kind = lambda u: F.when(F.lower(u).rlike(r"\.(png|jpe?g|gif|webp|svg)$"), "image").when(F.lower(u).rlike(r"\.(mp3|wav|ogg|m4a)$"), "audio").when(F.lower(u).rlike(r"\.(mp4|webm|mov|avi)$"), "video").otherwise("link")
    return F.transform(urls, lambda u: F.struct(u.alias("url"), kind(u).alias("kind")))


#: Kinds of media by the end of a url, a query of up to 200 characters included.
MEDIA_URLS = {"image": r"(?i)\.(png|jpg|jpeg|gif|webp|svg|bmp)(\?\S{0,200})?$", "audio": r"(?i)\.(mp3|wav|ogg|flac|aac|m4a)(\?\S{0,200})?$", "video": r"(?i)\.(mp4|webm|avi|mov|mkv)(\?\S{0,200})?$"}


def media_references(text: Column) -> Column:
    """(kind, url, description) of a text's media, in order: an embedded image, urls by their end, markdown images."""
    item = lambda kind, url, said: F.struct(kind.alias("kind"), url.alias("url"), said.alias("description"))
    last = lambda u: F.element_at(F.split(u, "/"), -1)
    null = F.lit(None).cast("string")
    form = F.regexp_extract(text, r"(?i)data:image/(png|jpeg|gif|webp);base64,", 1)
    data = F.when(form != "", F.array(item(F.lit("image"), null, F.concat(F.lit("[Image: "), F.upper(form), F.lit(" format, base64 encoded]")))))
    urls = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bhttps?://\S+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;)\]}>\"']+$", ""))
    kind = lambda u: F.when(u.rlike(MEDIA_URLS["image"]), "image").when(u.rlike(MEDIA_URLS["audio"]), "audio").when(u.rlike(MEDIA_URLS["video"]), "video")
    title = lambda u: F.when(u.rlike(MEDIA_URLS["image"]), "[Image URL: ").when(u.rlike(MEDIA_URLS["audio"]), "[Audio: ").otherwise("[Video: ")
    linked = F.transform(F.filter(urls, lambda u: kind(u).isNotNull()), lambda u: item(kind(u), u, F.concat(title(u), last(u), F.lit("]"))))
    shown = F.regexp_extract_all(text, F.lit(r"!\[[^\]]{0,200}\]\(([^)]{0,500})\)"), F.lit(1))
    pictures = F.transform(shown, lambda u: item(F.lit("image"), u, F.concat(F.lit("[Image: "), F.when(last(u) == "", "embedded").otherwise(last(u)), F.lit("]"))))
    empty = F.array().cast("array<struct<kind:string,url:string,description:string>>")
    return F.concat(F.coalesce(data, empty), F.coalesce(linked, empty), F.coalesce(pictures, empty))


# --- message parts, predicates, styles ------------------------------------------------------------

REASONING = {"code-generation": "chain-of-thought", "code-review": "tree-of-thoughts", "code-debugging": "tree-of-thoughts", "architecture-design": "graph-of-thoughts", "data-analysis": "chain-of-thought", "documentation": "direct", "testing": "tree-of-thoughts", "deployment": "direct", "security-audit": "graph-of-thoughts", "refactoring": "chain-of-thought", "quick-answer": "direct", "creative-writing": "tree-of-thoughts"}
TASK_MAP = {"code-generation": "coding", "code-debugging": "debugging", "code-review": "review", "architecture-design": "planning", "refactoring": "coding", "testing": "coding", "deployment": "coding", "security-audit": "review", "data-analysis": "planning", "documentation": "planning", "quick-answer": "question", "creative-writing": "conversation"}
LOOKUP_TASK = (("simple_lookup", ("find", "search", "get", "retrieve", "lookup", "show", "what is", "where is")), ("multi_lookup", ("list all", "find all", "count all", "sum all", "all of", "every")), ("summarization", ("summarize", "overview", "summary", "brief", "tldr", "synopsis")), ("complex_reasoning", ("analyze", "compare", "sort", "rank", "prioritize", "evaluate", "why", "how", "explain", "reason")))
CONTEXT_WORDS = "typescript compile build deploy test refactor error bug fix security performance api database memory session token context config".split()
STYLES = {"descriptive": "[Context] Relevant information:\n{items}", "prescriptive": "[Context] Use the following to answer:\n{items}", "prohibitive": "[Context] Available (DO NOT use items tagged [exclude]):\n{items}", "explanatory": "[Context] Selected because: {reasons}\n\nRelevant items:\n{items}", "conditional": "[Context] If the request involves: {conditions}\nConsider:\n{items}"}
STYLE_OF_TASK = {"coding": "prescriptive", "review": "explanatory", "debugging": "conditional", "planning": "descriptive", "question": "descriptive", "conversation": "descriptive"}
MODALITY_ORDER = ("image", "audio", "video", "text")


def blocks_text(blocks: Column, sep: str = " ") -> Column:
    """B1: the blocks' texts, or thoughts, joined."""
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], b["thinking"], F.lit(""))), sep)


def is_derived(content: Column, schema_version: Column, by: Column, source: Column, prefix: str = "[Compacted History") -> Column:
    """An entry that compaction wrote."""
    return ((schema_version == 1) & by.isNotNull() & source.isNotNull()) | content.startswith(prefix)


def legacy_theme(text: Column) -> Column:
    """The theme of a stored summary: of its JSON, else what follows 'Working on:', else the default."""
    said = F.regexp_extract(text, r"Working on:\s*([^.]*)", 1)
    return F.coalesce(F.get_json_object(text, "$.theme"), F.when(F.trim(said) != "", F.trim(said)), F.lit("General discussion"))


def status_key(task: Column, stage: Column, errors: Column, fallback: Column) -> Column:
    """Task or fallback, stage and the first five error ids, those that are given."""
    parts = F.concat(F.array(F.coalesce(F.when(task != "", task), fallback, F.lit("")), F.coalesce(stage, F.lit(""))), F.slice(F.coalesce(errors, F.expr("cast(array() as array<string>)")), 1, 5))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


#: Fixed parts of summaries, which are no content.
SCAFFOLD = ("Continue with the current task using the remaining recent context below.", "Recorded Findings:", "Workspace State:", "Next Action:", "[Compacted History")


def without_scaffold(text: Column, fragments: tuple[str, ...] = SCAFFOLD) -> Column:
    """A summary with a space for each fixed part of its template."""
    for f in fragments:
        text = F.replace(text, F.lit(f), F.lit(" "))
    return text


def capped(text: Column, most: int) -> Column:
    """B15."""
    return F.substring(text, 1, most)


def message_tokens(text: Column, blocks: Column) -> Column:
    """Tokens of a text, or of its blocks' texts and inputs; blocks without any count ten."""
    b = F.aggregate(F.transform(blocks, lambda x: heuristic_tokens(F.coalesce(x["text"], x["input"], F.lit("")))), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(text.isNotNull(), heuristic_tokens(text)).otherwise(F.when(b == 0, 10).otherwise(b))


def lookup_task(query: Column) -> Column:
    """The class with the most keywords, the first of equals."""
    low, kind, best = F.lower(query), F.lit("simple_lookup"), F.lit(0)
    for name, words in LOOKUP_TASK:
        n = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
        kind, best = F.when(n > best, name).otherwise(kind), F.greatest(best, n)
    return kind


def reasoning(task: Column, complex_: Column) -> Column:
    """The strategy of a task, else by complexity."""
    out = F.when(complex_ >= 0.7, "graph-of-thoughts").when(complex_ >= 0.5, "tree-of-thoughts").otherwise("chain-of-thought")
    for t, s in REASONING.items():
        out = F.when(task == t, s).otherwise(out)
    return out


def mapped_task(task: Column) -> Column:
    """J8."""
    out = F.lit("unknown")
    for a, b in TASK_MAP.items():
        out = F.when(task == a, b).otherwise(out)
    return out


def context_words(text: Column) -> Column:
    """Listed keywords that occur as substrings."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, CONTEXT_WORDS)), lambda w: F.contains(low, w))


def styled(items: Column, style: str, reasons: Column | None = None, conditions: Column | None = None) -> Column:
    """An array of texts in a style's template."""
    out = F.lit(STYLES[style])
    out = F.replace(out, F.lit("{items}"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))
    out = F.replace(out, F.lit("{reasons}"), reasons if reasons is not None else F.lit("general relevance"))
    return F.replace(out, F.lit("{conditions}"), conditions if conditions is not None else F.lit("any of the above topics"))


def modality_rank(kind: Column) -> Column:
    """Image, audio, video, text, others last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MODALITY_ORDER)), kind), F.lit(0)), F.lit(99))


def preload_rank(kind: Column, priority: Column) -> Column:
    """Place in the model's list; unknown last."""
    return F.coalesce(F.nullif(F.array_position(priority, kind), F.lit(0)) - 1, F.lit(999))


def position_marker(text: Column, i: Column, n: Column) -> Column:
    """A mark before every message but the first and the last, in sessions of more than two."""
    return F.when((n > 2) & (i > 0) & (i < n - 1), F.concat(F.lit("[Position "), (i + 1).cast("string"), F.lit("/"), n.cast("string"), F.lit("] "), text)).otherwise(text)


def describe_media(kind: Column, url: Column) -> Column:
    """A fixed line for a medium."""
    return F.when(kind == "image", F.concat(F.lit("[Image: "), url, F.lit("]"))).when(kind == "audio", F.concat(F.lit("[Audio transcript unavailable: "), url, F.lit("]"))).when(kind == "video", F.concat(F.lit("[Video: "), url, F.lit("]"))).otherwise(url)


def json_summary(text: Column) -> Column:
    """What a JSON text is: an array and its length, an object and its fields, or itself."""
    keys, size = F.json_object_keys(text), F.json_array_length(text)
    names = F.array_join(F.slice(keys, 1, 5), ", ")
    obj = F.when(F.size(keys) == 0, "Empty object").when(F.size(keys) <= 5, F.concat(F.lit("Object with fields: "), names)).otherwise(F.concat(F.lit("Object with "), F.size(keys).cast("string"), F.lit(" fields: "), names, F.lit("... and "), (F.size(keys) - 5).cast("string"), F.lit(" more")))
    return F.when(size == 0, "Empty array").when(size.isNotNull(), F.concat(F.lit("Array with "), size.cast("string"), F.lit(" items"))).when(keys.isNotNull(), obj).otherwise(text)


def recovery_overlap(text: Column, summary: Column, least: int = 3) -> Column:
    """I32: a message that restates a summary: so many common words of six letters and more."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"[^a-z0-9_./-]+"), lambda w: F.char_length(w) >= 6))
    return F.size(F.array_intersect(words(text), words(summary))) >= least
