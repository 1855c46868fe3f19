"""Text as columns: tokenizers, word sets, stripping and detection by pattern. Column -> Column, JVM-side only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"
#: Words of which exactly one side of a contradiction holds some.
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "wasn't", "weren't", "don't", "doesn't", "didn't", "can't", "won't", "shouldn't", "couldn't", "не", "нет", "никогда", "ни", "без")
#: What a user says who corrects an answer.
FRICTION = (
    r"no,?\s+i\s+meant", r"that'?s\s+not\s+what", r"(?:^|\s)wrong\b", r"actually,?\s+i", r"try\s+again", r"not\s+what\s+i\s+asked",
    r"i\s+said\b", r"нет,?\s+я\s+имел", r"не\s+то\b", r"неправильно", r"я\s+просил", r"переделай",
)
#: Words of informal style, and marks of technical style.
INFORMAL = ("hey", "lol", "btw", "pls", "thx", "gonna", "wanna", "ya", "yep", "nope", "nah", "cool", "haha", "ok", "ty", "np", "bruh")
TECHNICAL = r"(?i)`[^`]+`|```|\b(?:API|JSON|SQL|HTTP|async|function|class|import|def|return|const|var|let)\b"
#: Request words that make a question complex, or medium.
COMPLEX = (
    "проанализируй", "сравни", "спланируй", "архитектур", "рефактор", "analyze", "compare", "plan", "architect", "refactor", "debug complex",
    "напиши большой", "write a full", "design system", "evaluate",
)
MEDIUM = ("напиши", "объясни", "помоги с", "создай", "сделай", "write", "explain", "help with", "create", "build", "implement", "fix", "исправь", "обнови", "update")
#: Invisible characters.
INVISIBLE = r"[​-‏ - ⁠-⁤⁪-⁯﻿­͏؜ᅟᅠ឴឵᠎ﾠ]+"
#: Labelled secret patterns, the first that matches counts.
SECRETS = (
    (r"(?:sk-|sk-proj-)[A-Za-z0-9_-]{20,}", "OpenAI API key"), (r"AIza[A-Za-z0-9_-]{35}", "Google API key"), (r"AKIA[A-Z0-9]{16}", "AWS Access Key ID"),
    (r"ghp_[A-Za-z0-9]{36,}", "GitHub personal access token"), (r"gho_[A-Za-z0-9]{36,}", "GitHub OAuth token"), (r"glpat-[A-Za-z0-9_-]{20,}", "GitLab personal access token"),
    (r"xox[boaprs]-[A-Za-z0-9-]{10,}", "Slack token"), (r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "SSH/TLS private key"),
    (r"-----BEGIN PGP PRIVATE KEY BLOCK-----", "PGP private key"), (r"""(?:^|["'])(?:eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)""", "JWT token"),
    (r"(?i)(?:heroku|npm|pypi|nuget)[_-]?(?:api[_-]?key|token)\s*[:=]\s*\S{10,}", "Service token"),
)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def words(text: Column) -> Column:
    """White-space separated words in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0))


def terms(text: Column) -> Column:
    """Index terms: runs of letters and digits, lower case, without accents."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, FOLDED), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def letter_runs(text: Column) -> Column:
    """Distinct runs of three or more letters in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0)))


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def overlap(query: Column, doc: Column) -> Column:
    """Share of the query's distinct words in the document's."""
    return common(query, doc) / F.greatest(F.size(F.array_distinct(query)), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(common(a, b).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def least_overlap(a: Column, b: Column) -> Column:
    """Common words over the smaller set."""
    return F.coalesce(F.try_divide(common(a, b).cast("double"), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))), F.lit(0.0))


def denies(words_: Column) -> Column:
    """Whether an array of words holds a word that denies."""
    return F.arrays_overlap(words_, F.array(*map(F.lit, NEGATIONS)))


def contradiction(new: Column, old: Column) -> Column:
    """negation, replacement or null, from two word arrays."""
    both = F.array_distinct(F.array_union(new, old))
    replaced = (common(new, old) >= 2) & (F.size(F.array_except(new, old)) > 0) & (F.size(F.array_except(old, new)) > 0) & (common(new, old) / F.size(both) >= 0.4)
    return F.when(denies(new) != denies(old), "negation").when(replaced, "replacement")


def content_hash(text: Column) -> Column:
    return F.md5(F.lower(strip(text)))


def friction(text: Column) -> Column:
    """correction, or null."""
    return F.when(F.lower(text).rlike("|".join(f"(?:{p})" for p in FRICTION)), "correction")


def secret(text: Column) -> Column:
    """The first label whose pattern matches, or null."""
    return F.coalesce(*(F.when(text.rlike(p), label) for p, label in SECRETS))


def hits(text: Column, markers) -> Column:
    """How many of the markers stand in the lower-case text."""
    return reduce(lambda a, b: a + b, (F.lower(text).contains(m).cast("int") for m in markers))


def complexity(text: Column) -> Column:
    """Score of a request: length, markers, short questions."""
    hard = hits(text, COMPLEX)
    n = F.length(text)
    return (
        F.when(n > 500, 2).when(n > 100, 1).otherwise(0) + hard * 2 + F.when(hard == 0, hits(text, MEDIUM)).otherwise(0)
        - F.when(F.lower(text).endswith("?") & (n < 80) & (hard == 0), 1).otherwise(0)
    )


def tier(score: Column) -> Column:
    return F.when(score >= 3, "complex").when(score >= 1, "medium").otherwise("simple")


def style(text: Column) -> Column:
    """struct of formality, verbosity, technical_level, emoji_usage (0 to 1) and language."""
    tokens = words(text)
    n = F.greatest(F.size(tokens), F.lit(1))
    informal = F.size(F.filter(tokens, lambda w: w.isin(*INFORMAL)))
    sentences = F.filter(F.split(text, "[.!?]+"), lambda s: strip(s) != "")
    per = F.aggregate(sentences, F.lit(0), lambda a, s: a + F.regexp_count(s, F.lit(r"\S+"))) / F.greatest(F.size(sentences), F.lit(1))
    emoji = F.regexp_count(text, F.lit(r"[\x{1F600}-\x{1F9FF}]|[☀-⛿]|[✀-➿]"))
    unit = lambda x: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 6)
    return F.struct(
        unit(1.0 - informal / n * 10).alias("formality"), unit(per / 20).alias("verbosity"), unit(F.regexp_count(text, F.lit(TECHNICAL)) / n * 20).alias("technical_level"),
        unit(emoji / n * 10).alias("emoji_usage"), F.when(F.regexp_count(text, F.lit("[а-яА-ЯёЁ]")) > F.length(text) * 0.3, "ru").otherwise("en").alias("language"),
    )


def style_guidance(s: Column) -> Column:
    """Lines of guidance for a style profile; empty where there is nothing to say."""
    lines = F.array_compact(F.array(
        F.when(s["formality"] < 0.3, "Use casual, informal tone").when(s["formality"] > 0.7, "Use formal, professional tone"),
        F.when(s["verbosity"] < 0.3, "Be very concise and brief").when(s["verbosity"] > 0.7, "Provide detailed explanations"),
        F.when(s["technical_level"] > 0.7, "Use technical terminology freely").when(s["technical_level"] < 0.3, "Explain technical concepts simply"),
        F.when(s["emoji_usage"] > 0.5, "Include relevant emoji"), F.when(s["language"] == "ru", "Respond in Russian"),
    ))
    return F.when(F.size(lines) > 0, F.concat(F.lit("\n\n## Style guidance:\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")


#: Markdown marks in the order of their removal, with what stays.
MARKDOWN = (
    (r"```[\s\S]*?```", ""), (r"!\[([^\]]*)\]\([^\)]+\)", "$1"), (r"\[([^\]]+)\]\([^\)]+\)", "$1"), (r"`([^`]+)`", "$1"), (r"\*\*(.+?)\*\*", "$1"),
    (r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "$1"), (r"(?<!_)_(?!_)(.+?)(?<!_)_(?!_)", "$1"), (r"~~(.+?)~~", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^>\s?", ""),
    (r"(?m)^[-*_]{3,}\s*$", ""), (r"(?m)^[\s]*[-*+]\s", ""), (r"(?m)^[\s]*\d+\.\s", ""), (r"<[^>]+>", ""), (r"\n{3,}", "\n\n"),
)


def strip_markdown(text: Column) -> Column:
    return strip(reduce(lambda t, p: F.regexp_replace(t, F.lit(p[0]), F.lit(p[1])), MARKDOWN, text))


def speech_directives(text: Column) -> Column:
    """The keys and values of [[tts:key=value key=value]] marks as a map."""
    body = F.array_join(F.regexp_extract_all(text, F.lit(r"(?i)\[\[tts:([^\]]*=[^\]]*)\]\]"), F.lit(1)), " ")
    return F.when(body != "", F.str_to_map(F.regexp_replace(body, r"\s+", " "), F.lit(" "), F.lit("="))).otherwise(F.create_map().cast("map<string,string>"))
