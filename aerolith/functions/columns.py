"""Row-level transforms: numbers, text, links, labels and file kinds."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of failures, in their order of priority, and other names for them.
LABELS = ["mechanical_failure", "motor_imbalance", "thrust_loss", "setup_error", "vibration_high", "compass_interference", "gps_quality_poor", "ekf_failure", "power_instability", "brownout", "rc_failsafe", "pid_tuning_issue", "crash_unknown", "healthy"]
# The first bytes of file kinds, in hex, in the order they are tried.
SIGNATURES = [("png", "89504E47"), ("gif", "47494638"), ("jpg", "FFD8FF"), ("pdf", "25504446"), ("zip", "504B0304")]

#: A character reference, a mark of citation as chat programs leave it, and white space of any kind.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
CITATION = r"[ \t\r\n]*\[web:[0-9]+\]"
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def number(value: Column, default: float = 0.0) -> Column:
    """A number from text; what is none, or NaN, is the default."""
    cast = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    return F.coalesce(F.nanvl(cast, F.lit(None).cast("double")), F.lit(default))


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def any_bit_unset(status: Column, mask: int) -> Column:
    return status.bitwiseAND(F.lit(mask)) != mask


def channels(fields: Column, least: float = 800.0) -> Column:
    """Numbers over `least` of the fields C1, C2, ... or Ch1, Ch2, ..."""
    own = F.map_filter(fields, lambda k, v: k.rlike("^(C|Ch)[0-9]+$") & (number(v) > least))
    return F.transform(F.map_values(own), lambda v: number(v))


def unescaped(text: Column) -> Column:
    """Character references decoded in one pass: decimal, hexadecimal and those named in HTML 4; unknown names stay.

    Numbers from 128 to 159 are read as windows-1252, as browsers do; those of no character become U+FFFD.
    """
    named = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))], F.lit("apos"), F.lit("'"))
    western = F.create_map(*[F.lit(x) for code in range(128, 160) if (char := bytes([code]).decode("cp1252", "ignore")) for x in (code, char)])

    def decoded(reference: Column) -> Column:
        inner = F.substring(reference, F.lit(2), F.length(reference) - 2)
        hexadecimal = F.lower(F.substring(inner, 2, 1)) == "x"
        code = F.when(hexadecimal, F.conv(F.substring(inner, F.lit(3), F.length(inner)), 16, 10)).otherwise(F.substring(inner, F.lit(2), F.length(inner))).cast("int")
        sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(sound, F.coalesce(F.try_element_at(western, code), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise("\ufffd")
        return F.when(reference.startswith("&#"), char).otherwise(F.coalesce(F.try_element_at(named, inner), reference))

    pieces, references = F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    return F.array_join(F.zip_with(pieces, references, lambda p, r: F.concat(p, F.coalesce(decoded(r), F.lit("")))), "")


def stripped_html(html: Column) -> Column:
    """Text without tags and marks of citation, character references decoded, white space made single; null is empty."""
    text = unescaped(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, CITATION, ""), SPACE, " "))


def topic_url(url: Column, hosts: list[str], base: str) -> Column:
    """The topic that a link into a forum leads to, base/t/slug/id, without post number and query; null is empty.

    hosts: names under which the forum is known. Its other pages keep their path; other hosts' links stay, without last slashes.
    """
    clean = F.trim(F.regexp_replace(F.coalesce(url, F.lit("")), CITATION, ""))
    part = lambda group: F.regexp_extract(clean, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", group)
    topic = F.regexp_extract(part(2), "/t/[^/]+/[0-9]+", 0)
    own = F.when(topic != "", F.concat(F.lit(base), topic)).otherwise(F.concat(F.lit(base), part(2)))
    return F.regexp_replace(F.when(F.lower(part(1)).isin(hosts), own).otherwise(clean), "/+$", "")


def canonical_url(url: Column) -> Column:
    """Scheme https, host in lower case without www or m, path without a last slash; no query, no fragment."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), r"/+$", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, path)).otherwise(F.lit(""))


def links(html: Column, pattern: str) -> Column:
    """The href values that match, in page order."""
    return F.filter(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1)), lambda x: x.rlike(pattern))


def signature(content: Column) -> Column:
    """empty, html, an image or archive kind, or binlike, by the first bytes."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.lower(F.substring(content, 1, 16).try_cast("string")) if hasattr(Column, "try_cast") else F.lower(F.substring(content, 1, 16).cast("string"))
    kind = F.when(F.octet_length(content) == 0, "empty").when(text.startswith("<!doctype") | text.startswith("<html"), "html")
    for name, first in SIGNATURES:
        kind = kind.when(head.startswith(first), name)
    return kind.otherwise("binlike")


def ordinal(value: Column, order: list[str], unknown: str) -> Column:
    """The place of a value in an order; others count as `unknown`."""
    out = F.when(value == order[0], 0)
    for i, x in enumerate(order[1:], 1):
        out = out.when(value == x, i)
    return out.otherwise(order.index(unknown))


def normalized_label(raw: Column, aliases: dict[str, str], valid: list[str]) -> Column:
    """An alias's label, else the text in lower case with underscores if that is a label, else null."""
    low = F.lower(F.trim(raw))
    plain = F.regexp_replace(low, r"[- ]", "_")
    out = F.when(plain.isin(valid), plain)
    for alias, label in aliases.items():
        out = F.when(low == alias, label).otherwise(out)
    return out


def multi_hot(labels: Column, names: list[str]) -> list[Column]:
    return [F.array_contains(labels, n).cast("int").alias(n) for n in names]
