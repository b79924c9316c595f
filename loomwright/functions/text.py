"""Text functions that return Columns; all stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce
from re import _constants, _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions import lexicons as L


def _folding() -> tuple[str, str]:
    """Latin letters whose compatibility decomposition is one letter and marks, and that letter."""
    pairs = []
    for code in (*range(0xAA, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code) and plain.isalnum():
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folding()


def _ascii_folding() -> tuple[str, str, str]:
    """Characters of which an ASCII one is left when their canonical decomposition loses its marks, that one, and a class of all marks."""
    pairs, marks = [], []
    for code in range(0x80, 0x20000):
        if unicodedata.category(chr(code)).startswith("M"):
            marks += [code]
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code).lower()) if not unicodedata.category(c).startswith("M"))
        if len(plain) == 1 and plain.isascii():
            pairs.append((chr(code), plain))
    firsts, lasts = [c for c in marks if c - 1 not in set(marks)], [c for c in marks if c + 1 not in set(marks)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs), "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip([*firsts, 0xE0100], [*lasts, 0xE01EF], strict=True)) + "]"


ASCII_FROM, ASCII_TO, _MARKS = _ascii_folding()
#: The SQL's regular expressions are RE2's: words, digits and white space are ASCII's there, and the vertical tab is no white space.
_ASCII_URL = L.URL.replace(r"\S", r"[^\t\n\f\r ]")
_NOT_ASCII = r"[^\x00-\x0A\x0C-\x7F]+"
_WORD = "(?-i:[A-Za-z0-9_])"
_ASCII_BORDER = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def clean_text(text: Column) -> Column:
    """Without fenced code and URLs, white space as single spaces, trimmed."""
    bare = F.regexp_replace(F.regexp_replace(text, L.CODE_BLOCK, " "), "(?U)" + L.URL, " ")
    return strip(F.regexp_replace(bare, r"(?U)\s+", " "))


def compatible(text: Column) -> Column:
    """Unicode compatibility form (NFKC), which no built-in function gives; texts of ASCII alone stay as they are."""
    import pandas as pd

    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    form.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(form, "string")(text)


def message_text(text: Column) -> Column:
    """NFKC, URLs as ``<URL>``, white space as single spaces, trimmed; null is empty."""
    t = F.regexp_replace(compatible(F.coalesce(text, F.lit(""))), "(?U)" + L.URL, " <URL> ")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(L.TOKEN), F.lit(0)), F.lower)


def normalize_text(text: Column) -> Column:
    """Lower case without accents: Latin letters by a table, other scripts by dropping marks."""
    return F.regexp_replace(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), r"\p{Mn}", "")


def ngrams(words: Column, n: int) -> Column:
    """All runs of n tokens, joined by spaces."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def ascii_text(text: Column) -> Column:
    """What isn't ASCII, and the vertical tab, as a character that no pattern knows, so that they are neither words nor digits nor
    white space. The long s and the Kelvin sign stay, see ``ascii_present``."""
    return F.when(_rare(text), F.regexp_replace(text, r"[^\x00-\x0A\x0C-\x7F\x{17F}\x{212A}]+", "\x01")).otherwise(F.regexp_replace(text, _NOT_ASCII, "\x01"))


def _rare(text: Column) -> Column:
    return F.contains(text, F.lit("\u017f")) | F.contains(text, F.lit("\u212a"))


def ascii_clean(text: Column) -> Column:
    """``clean_text`` with ASCII's white space."""
    bare = F.regexp_replace(F.regexp_replace(text, L.CODE_BLOCK, " "), _ASCII_URL, " ")
    return F.trim(F.regexp_replace(bare, r"[\t\n\f\r ]+", " "))


def _ascii_folded(text: Column, sharp_s: str) -> Column:
    # Spelled out, as Java may know fewer marks than \p{M} has today.
    return F.regexp_replace(F.translate(F.lower(text), ASCII_FROM + "ß", ASCII_TO + sharp_s), r"(?![\x00-\x7F])" + _MARKS, "")


def ascii_normal(text: Column) -> Column:
    """Lower case without accents; ß counts as a letter, what else isn't ASCII doesn't."""
    return F.regexp_replace(_ascii_folded(text, "_"), _NOT_ASCII, "\x01")


def _literals(parsed: _parser.SubPattern) -> frozenset[str]:
    """Strings of which one at least is in every match; empty if nothing is known. ASCII only, in lower case."""
    found, run = [], ""
    for op, value in [*parsed, (None, None)]:
        if op is _constants.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if len(run) > 1:
            found.append(frozenset([run]))
        run = ""
        if op is _constants.SUBPATTERN:
            found.append(_literals(value[3]))
        elif op is _constants.BRANCH:
            parts = [_literals(x) for x in value[1]]
            found.append(frozenset().union(*parts) if all(parts) else frozenset())
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0] > 0:
            found.append(_literals(value[2]))
    return max(found, key=lambda x: (min(map(len, x), default=0), -len(x)), default=frozenset())


@lru_cache(maxsize=None)
def literals(pattern: str) -> frozenset[str]:
    try:
        return _literals(_parser.parse(pattern))
    except Exception:  # a pattern of Java's own syntax says nothing here
        return frozenset()


def may_match(text: Column, pattern: str) -> Column | None:
    """Whether a match is possible, by plain search for what every match contains; null stays null. Far cheaper than the pattern."""
    known = [x for x in literals(pattern) if not any(y in x for y in literals(pattern) - {x})]
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in sorted(known)]) if known else None


def hits(text: Column, patterns: list[str], flags: str = "(?U)") -> Column:
    """Matches of all patterns together, in lower-case text."""
    total = F.lit(0)
    for p in patterns:
        found, possible = F.regexp_count(text, F.lit(flags + p)), may_match(text, p)
        total = total + (found if possible is None else F.when(~possible, 0).otherwise(found))
    return total


def any_case(text: Column) -> Column:
    """Lower case for plain searches: the letters that count as ASCII ones whatever the case are those."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))


def patterns_present(text: Column, patterns: list[str], lower: Column | None = None) -> Column:
    """Patterns that match at all, whatever the case. ``lower`` is the text's ``any_case``, if that is at hand."""
    total, lower = F.lit(0), any_case(text) if lower is None else lower
    for p in patterns:
        found, possible = text.rlike("(?iu)" + p).cast("int"), may_match(lower, p)
        total = total + (found if possible is None else F.when(~possible, 0).otherwise(found))
    return total


def ascii_present(text: Column, patterns: list[str], lower: Column | None = None) -> Column:
    """``patterns_present`` in what ``ascii_text`` gives. The long s and the Kelvin sign are s and k there, but no part of words."""
    return F.when(_rare(text), patterns_present(text, [p.replace(r"\b", _ASCII_BORDER) for p in patterns], lower)).otherwise(patterns_present(text, patterns, lower))


def speech_act_hits(normal: Column) -> dict[str, Column]:
    return {f"act_{k}": hits(normal, p) for k, p in L.SPEECH_ACTS.items()}


def speech_acts(text: Column, normal: Column | None = None, raw: dict[str, Column] | None = None) -> dict[str, Column]:
    """act_* columns. A question mark counts as a request when nothing else is there; an assertion is what is left.

    ``raw`` are the ``speech_act_hits``, if they are columns already.
    """
    t = normalize_text(text) if normal is None else normal
    acts = speech_act_hits(t) if raw is None else raw
    question = F.contains(text, F.lit("?")).cast("int")
    others = sum((acts[k] for k in acts if k != "act_request"), F.lit(0))
    asked = F.when((acts["act_request"] == 0) & (question == 1) & (others == 0), 1).otherwise(acts["act_request"])
    assertion = (t.rlike("[a-z0-9]") & (asked + others == 0)).cast("int")
    return acts | {"act_request": asked, "act_question_mark": question, "act_assertion": assertion}


def lexicon_counts(normal: Column, lexicon: dict[str, list[str]], prefix: str = "") -> dict[str, Column]:
    return {prefix + k: hits(normal, p) for k, p in lexicon.items()}


def language_signals(text: Column, normal: Column | None = None) -> dict[str, Column]:
    t = normalize_text(text) if normal is None else normal
    return speech_acts(text, t) | lexicon_counts(t, L.DECLARATIONS) | lexicon_counts(t, L.MOODS, "mood_") | lexicon_counts(t, L.EPISTEMICS, "epistemic_")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def count_of(text: Column, others: str) -> Column:
    """Characters that aren't ``others``, a class; runs of others go at once."""
    return F.char_length(F.regexp_replace(text, others + "+", ""))


def basic_features(text: Column, words: Column | None = None) -> dict[str, Column]:
    """``words`` are the tokens of the cleaned text, if they are at hand."""
    words = tokens(clean_text(text)) if words is None else words
    chars, alpha = F.char_length(text), count_of(text, r"\P{L}")
    upper, digit = count_of(text, r"(?U)\P{Lu}"), count_of(text, r"\P{Nd}")
    real = lambda c: c.cast("double")
    return {
        "char_count": real(chars), "token_count": real(F.size(words)), "unique_token_ratio": _share(F.size(F.array_distinct(words)), F.size(words)),
        "alpha_ratio": _share(alpha, chars), "upper_ratio": _share(upper, alpha), "digit_ratio": _share(digit, chars),
        "question_marks": real(F.regexp_count(text, F.lit(r"\?"))), "exclamation_marks": real(F.regexp_count(text, F.lit("!"))), "ellipsis": real(F.regexp_count(text, F.lit(r"\.\.\."))),
    }


def script_profile(text: Column) -> dict[str, Column]:
    """Shares of scripts among letters, number of letters, and whether scripts are mixed."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    letters = count(r"\p{L}")
    parts = {"latin": count(r"[\p{IsLatin}&&\p{L}]"), "cyrillic": count(r"[\p{IsCyrillic}&&\p{L}]"), "arabic": count(r"[\p{IsArabic}&&\p{L}]"), "cjk": count(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}&&[\p{L}]]")}
    parts["other"] = letters - sum(parts.values(), F.lit(0))
    out = {f"script_{k}_ratio": _share(v, letters) for k, v in parts.items()}
    kinds = sum(((v > 0).cast("int") for v in parts.values()), F.lit(0))
    return out | {"script_total_letters": letters.cast("double"), "script_mixed": (kinds > 1).cast("double")}


def noise_score(text: Column) -> Column:
    compact = F.regexp_replace(text, r"(?U)\s+", "")
    size = F.char_length(compact)
    unique = F.size(F.array_distinct(F.split(F.lower(compact), ""))) / size
    score = compact.rlike(r"(.)\1{20,}").cast("double") + F.when(text.rlike(r"(?i)base64,[A-Za-z0-9+/=]{120,}"), 2.0).otherwise(0.0)
    score = score + compact.rlike(r"[A-Za-z0-9+/=]{240,}").cast("double") + F.when(size >= 60, F.when(unique < 0.12, 1.0).otherwise(0.0)).otherwise(0.0)
    return F.when(size > 0, score).otherwise(0.0)


def interference_hits(clean: Column, lower: Column | None = None, present: Callable[..., Column] = patterns_present) -> dict[str, Column]:
    """``lower`` is ``any_case`` of the cleaned text."""
    return {k: present(clean, p, lower) for k, p in {"injection": L.INJECTIONS, "disclaimer": L.DISCLAIMERS}.items()}


def interference(text: Column, clean: Column | None = None, raw: dict[str, Column] | None = None) -> dict[str, Column]:
    """Hits of injection and disclaimer phrases in the cleaned text, formatting counts in the raw one, and scores.

    ``raw`` are the ``interference_hits``, if they are columns already.
    """
    t = clean_text(text) if clean is None else clean
    there = t != ""
    zero = lambda c: F.when(there, c).otherwise(F.lit(0))
    found = interference_hits(t) if raw is None else raw
    injection, disclaimer = zero(found["injection"]), zero(found["disclaimer"])
    fences, urls, emojis = zero(F.regexp_count(text, F.lit("```"))), zero(F.regexp_count(text, F.lit("(?U)" + L.URL))), zero(F.regexp_count(text, F.lit(r"[\x{1F300}-\x{1FAFF}]")))
    semantic, form = injection * F.lit(2.0) + disclaimer * F.lit(1.5), fences * F.lit(0.5) + urls * F.lit(0.3) + F.lit(0.1) * emojis
    return {
        "score": semantic + form, "score_semantic": semantic, "score_format": form, "noise_score": F.when(there, noise_score(text)).otherwise(0.0),
        "injection_hits": injection, "disclaimer_hits": disclaimer, "code_fences": fences, "urls": urls, "emojis": emojis,
    }


def incidence_hits(normal: Column) -> dict[str, Column]:
    return {k: hits(normal, p) for k, p in {"human": L.HUMAN, "prompt": L.PROMPTS, "tooling": L.TOOLING, "narrative": L.NARRATIVE}.items()}


def human_incidence(text: Column, normal: Column | None = None, raw: dict[str, Column] | None = None) -> dict[str, Column]:
    """References to humans, prompts, tools and situations; weighted scores; a coarse evidence type.

    ``raw`` are the ``incidence_hits``, if they are columns already.
    """
    found = incidence_hits(normalize_text(text) if normal is None else normal) if raw is None else raw
    human, prompt, tooling, narrative = (found[k] for k in ("human", "prompt", "tooling", "narrative"))
    scores = {"score_human": human * F.lit(2.5), "score_prompt": prompt * F.lit(1.5), "score_narrative": narrative * F.lit(0.9), "score_tooling": tooling * F.lit(0.15)}
    kind = F.when(human >= 1, "humano_explicito").when((narrative >= 2) & (tooling <= 2) & (prompt == 0), "narrativa").when((prompt >= 2) & (tooling >= 2), "prompt_tooling")
    kind = kind.when(prompt >= 2, "prompt").when((tooling >= 6) & (narrative == 0), "tooling").otherwise("mixto")
    refs = {"human_refs": human, "prompt_refs": prompt, "tooling_refs": tooling, "narrative_refs": narrative}
    total = scores["score_human"] + scores["score_prompt"] + scores["score_narrative"] + scores["score_tooling"]
    return {"human_incidence_score": total} | scores | {k: v.cast("double") for k, v in refs.items()} | {"evidence_type": kind}


def canonical_signature(text: Column) -> tuple[Column, Column]:
    """Masked, punctuation-free text of at most 280 characters, and the first 16 hex digits of its SHA-1."""
    t = F.regexp_replace(normalize_text(clean_text(text)), "(?iU)" + L.URL, " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)@[a-z0-9_]{2,}", "@user"), r"(?U)\b\d+\b", "0")
    t = F.left(strip(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9@#\s]", " "), r"(?U)\s+", " ")), F.lit(280))
    return t, fingerprint(t)


def ascii_canonical(clean: Column, head: Column) -> Column:
    """The canonical text of what ``ascii_clean`` gives, with ASCII's words, digits and white space.

    ``head`` is its ``ascii_head``: no match goes over a space, so the first tokens do where they give 280 characters.
    """
    return F.left(F.when(F.char_length(head) >= 280, head).otherwise(_ascii_masked(clean)), F.lit(280))


def ascii_head(clean: Column) -> Column:
    return _ascii_masked(F.regexp_extract(clean, "(?s)^.{0,1000} ", 0))


def _ascii_masked(clean: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(_ascii_folded(clean, " "), "(?iu)" + _ASCII_URL, " "), _NOT_ASCII, " ")
    t = F.regexp_replace(F.regexp_replace(t, "@[a-z0-9_]{2,}", "@user"), r"\b\d+\b", "0")
    # [^a-z0-9@#], which takes Java ten times as long.
    return F.trim(F.regexp_replace(t, r"[\x00-\x22\x24-\x2F\x3A-\x3F\x41-\x60\x7B-\x7F]+", " "))


def fingerprint(canonical: Column) -> Column:
    return F.when(canonical != "", F.substring(F.sha1(canonical), 1, 16)).otherwise("")


def excerpt(text: Column, n: int = 220) -> Column:
    t = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.char_length(t) > n, F.concat(F.left(t, F.lit(n - 1)), F.lit("…"))).otherwise(t)


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)@(\w[\w\-]{1,49})"), F.lit(1))


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)#([\w\-]{1,50})"), F.lit(1))


def emojis(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\x{1F300}-\x{1FAFF}]"), F.lit(0))


def language_or_unknown(text: Column, provided: Column, detect: Callable[[Column], Column] | None = None) -> Column:
    """The language given, in lower case; else what ``detect`` says of texts of four characters or more; else "unknown"."""
    found = F.when(F.char_length(strip(text)) >= 4, detect(text)) if detect else F.lit(None)
    return F.lower(F.coalesce(F.nullif(provided, F.lit("")), found, F.lit("unknown")))


def links(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("(?iU)(" + L.URL + ")"), F.lit(1)), norm_url)


def norm_url(raw: Column) -> Column:
    clean = F.regexp_replace(strip(raw), r"""[).,;!?:"\]']+$""", "")
    return F.when(clean.startswith("www."), F.concat(F.lit("http://"), clean)).otherwise(clean)


def domain_for(url: Column) -> Column:
    """Host and port in lower case without www., null where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(""))


def occurrences(text: Column, pattern: str) -> Column:
    """array<struct<value, position>> of group 1 of a pattern whose matches begin one character before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    gaps = F.split(text, pattern, -1)
    both = F.transform(F.array(F.struct(gaps.alias("g"), found.alias("m"))), lambda s: F.transform(
        s["m"], lambda x, i: F.struct(x.alias("value"), (F.aggregate(F.slice(s["g"], F.lit(1), i + 1), F.lit(0), lambda a, v: a + F.char_length(v)) + F.aggregate(F.slice(s["m"], F.lit(1), i), F.lit(0), lambda a, v: a + F.char_length(v) + 1)).alias("position"))
    ))
    return both[0]


def meme_class(phrase: Column) -> Column:
    """struct<category, score, reasons>: conversational phrase or technical boilerplate."""
    words = F.filter(F.split(F.lower(strip(phrase)), r"(?U)\s+"), lambda t: t != "")
    among = lambda names: F.exists(words, lambda t: t.isin(names))
    number = lambda names: F.size(F.filter(words, lambda t: t.isin(names)))
    url, cli = among(L.URL_TOKENS), among(L.CLI_TOKENS)
    tld = among(L.TLD_TOKENS) & F.exists(words, lambda t: (F.char_length(t) >= 4) & t.rlike(r"^\p{L}+$"))
    api, camp, infra = number(L.API_TOKENS), number(L.CAMPAIGN_TOKENS), number(L.INFRA_TOKENS)
    zero_x, hexa = F.exists(words, lambda t: t.startswith("0x")), F.exists(words, lambda t: t.rlike(r"(?i)^(?:0x)?[0-9a-f]{4,}$"))
    weak = (infra > 0) & ((api > 0) | (camp > 0) | cli)
    digits, digits3 = F.exists(words, lambda t: t.rlike(r"^\p{Nd}{2,}$")), F.exists(words, lambda t: t.rlike(r"^\p{Nd}{3,}$"))
    steps = [
        (url, F.lit(3), F.lit("url_token")), (tld, F.lit(3), F.lit("tld_token")), (cli, F.lit(3), F.lit("cli_token")),
        (api > 0, F.least(F.lit(6), api * 2), F.concat(F.lit("api_token:"), api.cast("string"))), (zero_x, F.lit(3), F.lit("0x_token")), (hexa, F.lit(3), F.lit("hex_token")),
        (camp > 0, F.least(F.lit(6), camp * 2), F.concat(F.lit("campaign_token:"), camp.cast("string"))), (weak, F.lit(2), F.concat(F.lit("infra_token:"), infra.cast("string"))), (digits, F.lit(1), F.lit("digits")),
    ]
    score = sum((F.when(c, n).otherwise(0) for c, n, _ in steps), F.lit(0))
    technical = url | tld | cli | hexa | zero_x | (api > 0) | (camp > 0) | digits3 | (score >= 4)
    return F.struct(F.when(technical, "technical_boilerplate").otherwise("cultural_candidate").alias("category"), score.alias("score"), F.concat_ws("|", *[F.when(c, r) for c, _, r in steps]).alias("reasons"))


def first_largest(values: dict[str, Column], none: str | None) -> Column:
    """Name of the largest value, the first one winning ties; ``none`` if it is 0."""
    names = list(values)
    best = F.array_max(F.array(*[F.struct(values[k].cast("double").alias("v"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(names)]))
    return F.when(best["v"] > 0, best["k"]).otherwise(F.lit(none))


def looks_like_template(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?i)" + pattern)


def alnum_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]"))
