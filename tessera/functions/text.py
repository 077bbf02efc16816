"""Scalar functions over text (X1, X3, X9, X11-X31), each a pure Column function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges whose characters weigh 6 quarter tokens: CJK, kana, hangul, full-width forms.
WIDE = r"[\x{1100}-\x{11FF}\x{2E80}-\x{9FFF}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}]"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def quarter_tokens(text: Column) -> Column:
    """Quarters of tokens: a wide character weighs 6, one beyond the basic plane 8, any other 1."""
    return F.length(text) + F.regexp_count(text, F.lit(WIDE)) * 5 + F.regexp_count(text, F.lit(ASTRAL)) * 7


def token_estimate(text: Column) -> Column:
    """Estimated tokens; null and empty texts have none."""
    return F.coalesce(F.ceil(quarter_tokens(text) / 4), F.lit(0)).cast("long")


def truncate_to_tokens(text: Column, budget: int | Column, marker: str = "\n...\n", head: float = 0.75) -> Column:
    """The text, or where it is estimated above the budget its beginning (head of what the marker leaves) and end."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    room = budget * 4 - (len(marker) + 3)
    first = F.floor(room * head)
    last = room - first

    def cut(chars: Column) -> Column:
        weigh = lambda c: F.when(c.rlike(WIDE), 6).when(c.rlike(ASTRAL), 8).otherwise(1)
        fits = lambda cs, most: F.aggregate(cs, F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"), F.lit(False).alias("full")), lambda s, c: _let(s["w"] + weigh(c), lambda w: F.when(s["full"] | (w > most), F.struct(s["w"].alias("w"), s["n"].alias("n"), F.lit(True).alias("full"))).otherwise(F.struct(w.alias("w"), (s["n"] + 1).alias("n"), F.lit(False).alias("full")))))["n"]
        return F.concat(F.array_join(F.slice(chars, F.lit(1), fits(chars, first)), ""), F.lit(marker), _let(fits(F.reverse(chars), last), lambda n: F.array_join(F.slice(chars, F.size(chars) - n + 1, n), "")))

    over = token_estimate(text) > budget
    light = F.concat(F.substring(text, F.lit(1), first.cast("int")), F.lit(marker), F.right(text, last.cast("int")))  # every character weighs 1
    return F.when(over & (room <= 0), F.substring(text, F.lit(1), budget.cast("int"))).when(over & ~text.rlike(WIDE) & ~text.rlike(ASTRAL), light).when(over, _let(F.filter(F.split(text, ""), lambda c: c != ""), cut)).otherwise(text)


def apply_blocks(text: Column, blocks: Column) -> Column:
    """Struct of `text` and `error`: each block (search, replace; a null replace deletes) must find its search
    exactly once. On empty text all replaces are joined by line feeds; otherwise blocks with an empty search are ignored."""

    def step(s: Column, b: Column) -> Column:
        n = ((F.length(s["text"]) - F.length(F.replace(s["text"], b["search"], F.lit("")))) / F.length(b["search"])).cast("int")
        bad = F.concat(F.lit("found "), n.cast("string"), F.lit(" times: "), b["search"])
        done = F.struct(F.replace(s["text"], b["search"], F.coalesce(b["replace"], F.lit(""))).alias("text"), F.lit(None).cast("string").alias("error"))
        failed = F.struct(s["text"].alias("text"), bad.alias("error"))
        return F.when(s["error"].isNotNull() | (F.coalesce(b["search"], F.lit("")) == ""), s).when(n == 1, done).otherwise(failed)

    start = F.struct(text.alias("text"), F.lit(None).cast("string").alias("error"))
    fresh = F.struct(F.array_join(F.filter(F.transform(blocks, lambda b: b["replace"]), lambda r: r.isNotNull()), "\n").alias("text"), F.lit(None).cast("string").alias("error"))
    return F.when(F.coalesce(text, F.lit("")) == "", fresh).otherwise(F.aggregate(blocks, start, step))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def summary_section(text: Column) -> Column:
    """X11: text below a `# Summary` heading (levels 1-3) up to the next heading, else after `Summary:` up to a blank
    line, white space squeezed; '' if neither is there."""
    block = squeeze(F.regexp_extract(text, r"(?ims)^#{1,3}[ \t]+summary[ \t]*$\n(.*?)(?=^#{1,6}[ \t]|\z)", 1))
    line = squeeze(F.regexp_extract(text, r"(?is)\A\s*summary:\s*(.*?)(?=\n\s*\n|\z)", 1))
    return F.coalesce(F.when(block != "", block).otherwise(line), F.lit(""))


def doc_overview(text: Column, headings: int = 24, chars: int = 400) -> Column:
    """The first headings (levels 1-3, indented by level) and the first paragraph that is none, cut to `chars`."""
    lines = F.split(text, "\n")
    found = F.slice(F.filter(lines, lambda x: x.rlike(r"^#{1,3}\s+\S")), 1, headings)
    indented = F.transform(found, lambda x: F.concat(F.repeat(F.lit("  "), F.length(F.regexp_extract(x, "^(#+)", 1)) - 1), F.lit("- "), F.regexp_replace(x, r"^#+\s+", "")))
    first = F.get(F.filter(F.split(text, r"\n\s*\n"), lambda p: ~p.rlike(r"^\s*#") & (F.trim(p) != "")), F.lit(0))
    return F.array_join(F.concat(indented, F.array_compact(F.array(F.substring(squeeze(first), 1, chars)))), "\n")


def render_entry(uri: Column, tier: Column, score: Column, body: Column) -> Column:
    """One entry as an element: attributes escaped, the score with two decimals, end tags in the body taken apart."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    head = F.concat(F.lit('<entry uri="'), esc(uri), F.lit('" tier="'), esc(tier), F.lit('" score="'), F.format_string("%.2f", score), F.lit('"'))
    safe = F.regexp_replace(body, r"(?i)</(?=\s*entry\s*>)", "<\\\\/")
    return F.when(F.coalesce(F.trim(body), F.lit("")) == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">\n"), safe, F.lit("\n</entry>")))


def render_context(entries: Column) -> Column:
    """Rendered entries, an array in order, as one context."""
    return F.array_join(entries, "\n")


#: Words and letters that tell Latin-script languages apart, ties to the earlier.
STOP_WORDS = {
    "en": "a an and are as be document for from in is of on please project that the this to user with",
    "it": "che con da del della di documento e il la le non per preferenze progetto questo questa un una utente",
    "fr": "avec ce cette de des document du et la le les pour préférences projet que un une utilisateur",
    "es": "con de del documento el esta este la las los para preferencias proyecto que un una usuario y",
    "de": "benutzer das der die diese dieser dokument ein eine für ist mit nicht projekt und zu",
    "pt": "a as com da de do documento e este esta o os para preferências preferencias projeto que um uma usuário usuario",
}
ACCENTS = {"it": "[àèéìòù]", "fr": "[àâæçéèêëîïôœùûüÿ]", "es": "[áéíóúüñ¿¡]", "de": "[äöüß]", "pt": "[áâãàçéêíóôõú]"}
#: Letters of scripts; `grammar` are the kana that Chinese doesn't borrow.
LETTERS = {"zh": r"[\x{4E00}-\x{9FFF}]", "kana": r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}]", "ko": r"[\x{AC00}-\x{D7AF}]", "ru": r"[\x{0400}-\x{04FF}]", "ar": r"[\x{0600}-\x{06FF}]", "latin": r"[A-Za-z\x{00C0}-\x{024F}]"}
GRAMMAR = r"[\x{3041}-\x{306D}\x{306F}-\x{3096}]"
#: Fixed value: uris and bare domains with a path, which don't count for the language.
NOISE = r"\b(?:\w+://|(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}/)[^\s<>\])\"'`]+"


def language_evidence(text: Column) -> Column:
    """Counts of a text, as a map, from which `decided_language` tells its language; those of several texts add up."""

    def counts(t: Column) -> Column:
        n = lambda r: F.regexp_count(t, F.lit(r))
        words = F.regexp_extract_all(t, F.lit(r"[a-z\x{00C0}-\x{024F}]+"), F.lit(0))
        among = lambda v: F.size(F.filter(words, lambda x: x.isin(*v.split())))
        known = {f"stop_{k}": among(v) for k, v in STOP_WORDS.items()}
        found = {**{k: n(v) for k, v in LETTERS.items()}, "grammar": n(GRAMMAR), "words": F.size(words), **known, **{f"accent_{k}": n(v) for k, v in ACCENTS.items()}}
        return F.create_map(*(x for k, v in found.items() for x in (F.lit(k), v.cast("long"))))

    return _let(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), NOISE, " ")), counts)


def decided_language(evidence: Column, fallback: str = "en") -> Column:
    """The language that counts speak for: ja with 3 kana, if it is the fallback or grammar or their share say so; zh-CN,
    ko, ru or ar with 2 letters and a fifth of all, of which only zh-CN or the fallback need no 95 percent of 10
    letters at least; else a Latin-script language, which is en unless another has clearly more words and accents."""

    def decide(e: Column) -> Column:
        c = lambda k: e[k]
        total = sum((c(k) for k in LETTERS), F.lit(0))
        allowed = lambda k: F.lit(k in ("zh-CN", "en", fallback))
        dominant = lambda n: (n >= 10) & (n * 100 >= total * 95)
        japanese = c("zh") + c("kana")
        strong = (c("kana") >= 10) & (japanese * 100 >= total * 95) & (c("kana") * 10 >= japanese * 3)
        grammar = (c("grammar") >= 2) & (c("grammar") * 10 >= japanese)
        most = F.greatest(*(c(k) for k in ("zh", "ko", "ru", "ar")))
        other = F.lit(None).cast("string")
        for k, name in (("ar", "ar"), ("ru", "ru"), ("ko", "ko"), ("zh", "zh-CN")):
            clear = (c(k) >= 2) & (c(k) * 5 >= total) & (allowed(name) | dominant(c(k)))
            other = F.when(c(k) == most, F.when(clear, name)).otherwise(other)
        score = {k: c(f"stop_{k}") + (c(f"accent_{k}") if k in ACCENTS else 0) for k in STOP_WORDS}
        best, latin = F.greatest(*score.values()), F.lit("en")
        for k in reversed([k for k in STOP_WORDS if k != "en"]):
            hint = (c(f"accent_{k}") > 0) | (c(f"stop_{k}") >= 4)
            many = (c("words") >= 20) & (best >= 6) & (best >= score["en"] + 4)
            latin = F.when(score[k] == best, F.when((c("words") >= 6) & hint & (best >= 3) & (best >= score["en"] + 2) & (allowed(k) | many), k).otherwise("en")).otherwise(latin)
        latin = F.when((c("words") < 3) | (score["en"] == best), "en").otherwise(latin)
        ja = (c("kana") >= 3) & (allowed("ja") | strong | grammar)
        return F.when(ja, "ja").when(other.isNotNull(), other).when(c("latin") > 0, latin).otherwise(F.lit(fallback))

    return _let(evidence, decide)


def detect_language(text: Column, fallback: str = "en") -> Column:
    """Language of a text, uris left out; fallback where there are no letters."""
    return decided_language(language_evidence(text), fallback)


def normalize_answer(text: Column) -> Column:
    """Lower case without commas, punctuation and articles, spaces squeezed."""
    plain = F.regexp_replace(F.lower(F.replace(text, F.lit(","), F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(F.filter(F.split(plain, r"\s+"), lambda w: ~w.isin("a", "an", "the", "and", "")), " ")


#: Fixed values.
REFUSALS = ("not mentioned", "no information", "cannot be answered", "none", "unknown", "don't know")


def is_refusal(text: Column) -> Column:
    """Whether any phrase of REFUSALS occurs."""
    return F.lower(text).rlike("|".join(REFUSALS))


def epoch_to_ts(value: Column) -> Column:
    """Time of an epoch in seconds, or milliseconds above 10^10; null if not above 0."""
    return F.when(value > 10**10, F.timestamp_millis(value.cast("long"))).when(value > 0, F.timestamp_millis((value * 1000).cast("long")))


def canonical_hash(fields: dict[str, Column]) -> Column:
    """sha256 of the compact JSON object with sorted keys."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def conflict_tags(text: Column) -> Column:
    """Struct has_conflict, conflict_num, error from comment blocks `<!-- CONFLICT [json, ...] -->`."""

    def read(t: Column) -> Column:
        bodies = F.regexp_extract_all(t, F.lit(r"(?s)<!--\s*CONFLICT\b(.*?)-->"), F.lit(1))
        parsed = F.transform(bodies, lambda b: F.from_json(F.trim(b), "array<struct<id:string,text:string>>"))
        opened = F.regexp_count(t, F.lit(r"<!--\s*CONFLICT\b"))
        bad = (opened > F.size(bodies)) | F.exists(parsed, lambda p: p.isNull())
        n = F.aggregate(parsed, F.lit(0), lambda s, p: s + F.coalesce(F.size(p), F.lit(0)))
        return F.struct((n > 0).alias("has_conflict"), n.alias("conflict_num"), F.when(bad, "unclosed or invalid block").alias("error"))

    return _let(F.coalesce(text, F.lit("")), read)


def resource_uris(text: Column) -> Column:
    """Uris of the record scheme in prose, in order, each once, without punctuation that ends a sentence."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"ctx://[^\s<>\"'`\)\]\}，。；！？、]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def strip_markup_noise(md: Column) -> Column:
    """Markdown without inline data images and empty anchors, and with two blank lines in a row at most."""
    out = F.regexp_replace(md, r"!\[[^\]]*\]\(data:[^)]*\)", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?<!!)\[\s*\]\([^)]*\)", ""), r"\n{4,}", "\n\n\n")


def portable_segment(name: Column, most: int = 80) -> Column:
    """The name if it is a safe path segment, else a safe form of it with a hash of the name."""
    ok = name.rlike(r"^[A-Za-z0-9_\p{L}][A-Za-z0-9_.\-\p{L}]*$") & ~name.endswith(".") & (F.length(name) <= most)
    safe = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_.\-\p{L}]+", "_"), r"^[.\-_]+|[.\-_]+$", "")
    return F.when(ok, name).otherwise(F.concat(F.substring(safe, 1, most - 17), F.lit("_"), F.substring(F.sha2(name, 256), 1, 16)))


OUTCOMES = ("success", "failure", "partial", "abandoned", "unknown")


def outcome_norm(value: Column) -> Column:
    """One of OUTCOMES, unknown if none."""
    own = F.lower(F.trim(value))
    return F.when(own.isin(*OUTCOMES), own).otherwise("unknown")


def query_kind(value: Column, kinds: tuple[str, ...]) -> Column:
    """One of the kinds, unknown if none."""
    own = F.lower(F.trim(value))
    return F.when(own.isin(*kinds), own).otherwise("unknown")


def message_tokens(parts: Column) -> Column:
    """Estimated tokens of a message's parts (type, text, abstract, tool_id, tool_name, tool_input, tool_output); images count 0."""
    some = lambda *names: lambda p: F.concat(*(F.coalesce(p[n], F.lit("")) for n in names))
    text = lambda p: F.when(p["type"] == "text", some("text")(p)).when(p["type"] == "context", some("abstract")(p)).when(p["type"] == "tool", some("tool_id", "tool_name", "tool_input", "tool_output")(p)).otherwise("")
    return F.aggregate(F.coalesce(parts, F.array().cast("array<struct<type:string,text:string,abstract:string,tool_id:string,tool_name:string,tool_input:string,tool_output:string>>")), F.lit(0).cast("long"), lambda s, p: s + token_estimate(text(p)))


def preview_id(tool_id: Column, text: Column) -> Column:
    """`tr_<safe id>_<16 hex>`, or `tr_<24 hex>` without an id."""
    safe = F.regexp_replace(F.coalesce(tool_id, F.lit("")), "[^A-Za-z0-9_-]", "_")
    sha = F.sha2(text, 256)
    return F.when(safe != "", F.concat(F.lit("tr_"), safe, F.lit("_"), F.substring(sha, 1, 16))).otherwise(F.concat(F.lit("tr_"), F.substring(sha, 1, 24)))


#: Detectors of X19, ours: name and Java pattern.
PRIVACY = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "phone": r"(?<![\d\-])\+?\d{1,3}[ \-]?\(?\d{3}\)?[ \-]?\d{3}[ \-]?\d{4}(?![\d\-])",
    "secret": r"(?i)\b(?:api[_-]?key|token|password|secret)\s*[=:]\s*\"?[A-Za-z0-9_\-]{8,}\"?",
    "card": r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)",
}


def luhn(digits: Column) -> Column:
    """Whether the digits of a text pass the Luhn test."""
    ds = F.transform(F.filter(F.split(F.reverse(F.regexp_replace(digits, r"\D", "")), ""), lambda c: c != ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(ds, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)), F.lit(0), lambda s, x: s + x)
    return (F.size(ds) >= 13) & (total % 10 == 0)


def privacy_spans(text: Column, rules: dict[str, str] | None = None, never_mask: list[str] = ()) -> Column:
    """Array of (detector, start, stop, value), start from 0, of every match that isn't on the allow-list."""

    def of(name: str, pattern: str) -> Column:
        parts = F.split(F.regexp_replace(text, pattern, "\x00$0\x00"), "\x00")
        spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<struct<detector:string,start:int,stop:int,value:string>>").alias("out")), lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), (s["n"] + 1).alias("n"), F.when(s["n"] % 2 == 1, F.concat(s["out"], F.array(F.struct(F.lit(name).alias("detector"), s["at"].alias("start"), (s["at"] + F.length(p)).alias("stop"), p.alias("value"))))).otherwise(s["out"]).alias("out")))["out"]
        found = F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<detector:string,start:int,stop:int,value:string>>"))
        return F.filter(found, lambda s: luhn(s["value"])) if name == "card" else found

    every = F.concat(*(of(n, p) for n, p in (rules or PRIVACY).items()))
    return F.filter(every, lambda s: ~s["value"].isin(*never_mask)) if never_mask else every


def mask(text: Column, rules: dict[str, str] | None = None, with_: str = "[MASKED]") -> Column:
    """The text with all matches of the rules (cards without the Luhn test) replaced."""
    for pattern in (rules or PRIVACY).values():
        text = F.regexp_replace(text, pattern, with_.replace("$", "\\$"))
    return text
