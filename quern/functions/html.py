"""HTML as columns: titles, raw text, links, urls, address predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import strip

#: Entities with a name that are decoded, the ampersand last.
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Private networks as (first address, prefix length).
PRIVATE = (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8), ("169.254.0.0", 16), ("0.0.0.0", 8))


def chain(text: Column, steps) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, F.lit(p[0]), F.lit(p[1])), steps, text)


def decode(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), NAMED, text)


def title(html: Column) -> Column:
    return strip(decode(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


#: What becomes of tags in raw text, in this order.
RAW = (
    (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""),
    *((rf"(?i)<h{n}[^>]*>(.*?)</h{n}>", "#" * n + " $1\n") for n in range(1, 7)),
    (r"""(?i)<a[^>]+href=["']([^"']+)["'][^>]*>(.*?)</a>""", "[$2]($1)"), (r"(?i)<br\s*/?\s*>", "\n"), (r"(?i)</(p|div|section|article|li|tr|blockquote)>", "\n"), (r"<[^>]+>", ""),
)


def raw_text(html: Column) -> Column:
    """Readable text: headings as #, links as [text](url), blocks as lines, no tags."""
    return strip(chain(decode(chain(html, RAW)), ((r"[ \t]+", " "), (r"\n{3,}", "\n\n"))))


#: Entities that file stripping decodes, in this order, after white space was joined.
FILE_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def stripped(html: Column, keep_lines: bool = False) -> Column:
    """Plain text of an HTML file: no scripts, styles and tags, white space as one blank, then entities decoded."""
    steps = ((r"(?is)<(script|style)[^>]*>.*?</\1>", ""), *(((r"(?i)<br\s*/?>", "\n"),) if keep_lines else ()), (r"<[^>]+>", " "), (r"\s+", " "))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), FILE_ENTITIES, strip(chain(html, steps)))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a[^>]+href=["']([^"']+)["']"""), F.lit(1))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def absolute(base: Column, link: Column) -> Column:
    """A link against its page's url; null for what isn't http(s)."""
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^(https?://[^/]+(?:/.*)?/)[^/]*$", "$1")
    return (
        F.when(link.rlike("^https?://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), link))
        .when(link.startswith("/"), F.concat(origin(base), link)).when(link.rlike("^(#|[a-zA-Z][a-zA-Z0-9+.-]*:)"), None)
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )


def normalised(url: Column) -> Column:
    """Without fragment and trailing slash."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/$", "")


def in_domains(url: Column, domains: list[str]) -> Column:
    h = host(url)
    return reduce(lambda a, b: a | b, ((h == d) | h.endswith("." + d) for d in domains), F.lit(False))


def allowed(url: Column, block: list[str] = (), allow: list[str] = ()) -> Column:
    """Domain policy: in the allow list, if there is one, and not in the block list."""
    return (in_domains(url, list(allow)) if allow else F.lit(True)) & ~in_domains(url, list(block))


def private_address(h: Column) -> Column:
    """Whether a host is a literal address of a private network (names aren't resolved)."""
    parts = [F.regexp_extract(h, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k) for k in range(1, 5)]
    value = reduce(lambda a, p: a * 256 + F.coalesce(p.try_cast("long"), F.lit(0)), parts, F.lit(0).cast("long"))

    def within(address: str, bits: int) -> Column:
        first = reduce(lambda a, p: a * 256 + int(p), address.split("."), 0)
        return F.shiftright(value, 32 - bits) == first >> (32 - bits)

    six = h.isin("::1", "[::1]") | h.rlike(r"^\[?f[cd][0-9a-f]{2}:") | h.rlike(r"^\[?fe[89ab][0-9a-f]:")
    return F.when(parts[0] != "", reduce(lambda a, b: a | b, (within(*p) for p in PRIVATE))).otherwise(six)
