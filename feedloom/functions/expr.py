"""Column expressions shared by the operators; each names what an empty or null input gives."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error classes after which a task is tried again.
RETRYABLE = ("transient", "rate_limited", "timeout", "network", "unknown")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def stable_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by '|'; a null part is empty, and so is a number that is 0, or false."""
    nothing = lambda p: p.isNull() | ((F.typeof(p) != "string") & p.cast("string").rlike("^(?:-?0(?:[.]0+)?|false)$"))
    return F.sha2(F.concat_ws("|", *[F.when(nothing(p), "").otherwise(p.cast("string")) for p in parts]), 256)


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, each with its length before it, so that no two lists of fields look alike; null is '-'."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (x.cast("string") for x in fields)]), 256)


#: What of a record makes a new version when it changes.
HASHED = ("kind", "url", "title", "content", "content_type", "language", "published_at", "attributes", "tags")


def record_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of a record's nine fields in canonical form; the id and the time of observation don't count.

    Times are ISO 8601, attributes JSON texts with sorted keys, tags a JSON list; a field that `columns` lacks is null.
    """
    form = {"published_at": iso_utc, "attributes": hashed_json, "tags": F.to_json}
    return content_hash(*[form.get(c, lambda x: x)(F.col(c)) if c in columns else F.lit(None) for c in HASHED])


def hash_modulo(c: Column, m: int | Column) -> Column:
    """The 256-bit hash of a text modulo m, digit by digit."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substr(F.sha2(c, 256), i, F.lit(1)), 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % m)


def contains_all(required: Column, offered: Column) -> Column:
    """Whether every required element is offered; no requirement always is."""
    return F.size(F.array_except(required, offered)) == 0


def csv_array(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))


def retry_delay(
    attempts: Column, base: Column | int = 30, most: Column | int = 3600, backoff: Column | str = "exponential", retry_after: Column | None = None
) -> Column:
    """Seconds until the next attempt: what the server asks for, else base * 2^(attempts - 1), both at most `most`; fixed delays aren't cut."""
    base, most = (F.lit(x).cast("double") for x in (base, most))
    backoff = F.lit(backoff) if isinstance(backoff, str) else backoff
    doubled = F.least(most, base * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))))
    own = F.when(backoff == "exponential", doubled).otherwise(base)
    if retry_after is None:
        return own
    return F.when(retry_after.isNotNull(), F.least(most, F.greatest(F.lit(0.0), retry_after.cast("double")))).otherwise(own)


def retryable(error_class: Column, attempts: Column, most: Column) -> Column:
    return F.coalesce(error_class.isin(*RETRYABLE) & (attempts < most), F.lit(False))


def retry_after_seconds(header: Column, as_of: Column, fallback: float) -> Column:
    """A Retry-After header, seconds or an HTTP date, kept within 0 to 3600; what can't be read gives the fallback."""
    date = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]+, ", ""), F.lit("d MMM yyyy HH:mm:ss z")).cast("timestamp")
    ask = F.coalesce(header.try_cast("double"), date.cast("double") - as_of.cast("timestamp").cast("double"))
    return F.when(ask.isNull(), F.lit(fallback)).otherwise(F.least(F.lit(3600.0), F.greatest(F.lit(0.0), ask)))


def iso_utc(c: Column) -> Column:
    """ISO 8601 in UTC; microseconds are written only where there are any."""
    micros = F.when(F.date_format(c, "SSSSSS") != "000000", F.date_format(c, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), micros, F.lit("+00:00"))


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounds halves to the even neighbour."""
    return F.bround(c, digits)


def canonical_json(c: Column) -> Column:
    """A JSON text without spaces and with sorted keys; null for malformed ones, and those with a key that stands twice."""
    return F.to_json(F.try_parse_json(c))


def hashed_json(c: Column) -> Column:
    """A JSON text as it goes into a hash: canonical, or as it stands if it has no canonical form, so that two different ones differ."""
    return F.coalesce(canonical_json(c), c)


def parse_time(c: Column) -> Column:
    """ISO 8601 or RFC 2822 to a timestamp; without a zone UTC; null if neither."""
    rfc = F.try_to_timestamp(F.regexp_replace(c, "^[A-Za-z]+, *", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return F.coalesce(c.try_cast("timestamp"), rfc)


def path_segment(c: Column) -> Column:
    """A safe path segment: other characters to '_', '.' and '_' cut from the ends, 100 characters at most, a hash if nothing is left."""
    clean = F.substr(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_"), "^[._]+|[._]+$", ""), F.lit(1), F.lit(100))
    return F.coalesce(F.nullif(clean, F.lit("")), F.substr(F.sha2(c, 256), F.lit(1), F.lit(20)))


def redacted_url(c: Column) -> Column:
    """Scheme, host and path only."""
    return (
        F.concat(
            F.try_parse_url(c, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(c, F.lit("HOST")),
            F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))
        )
    )


def with_parameter(url: Column, name: str, value: Column) -> Column:
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit(f"{name}="), value.cast("string"))


def content_type_allowed(c: Column, allowed: Sequence[str]) -> Column:
    """Exact, `allowed+suffix`, or `+json` where JSON is allowed; a blank type passes."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(c, F.lit("")), F.lit(";"), F.lit(1))))
    fits = kind.isin(*allowed)
    for a in allowed:
        fits = fits | F.startswith(kind, F.lit(f"{a}+"))
    if "application/json" in allowed:
        fits = fits | F.endswith(kind, F.lit("+json"))
    return (kind == "") | fits


#: IPv4 networks that must not be fetched, as first address and prefix length: private, shared, loopback, link-local, protocol, test, multicast, reserved.
BLOCKED_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
#: IPv6 beginnings of the same kinds: loopback and unspecified, mapped IPv4, discard, documentation, unique local, link-local, site-local, multicast.
BLOCKED_V6 = r"^(::1?$|::ffff:|64:ff9b:1:|100::|2001:db8:|f[cd]|fe[89a-f]|ff)"


def ipv4_number(host: Column) -> Column:
    """The address as a number, null if it isn't a dotted one."""
    parts = F.split(host, "[.]")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long"))
    fits = host.rlike(r"^[0-9]{1,3}([.][0-9]{1,3}){3}$")
    return F.when(fits & F.forall(F.when(fits, parts).otherwise(F.array()), lambda p: p.cast("int") <= 255), number)


def private_address(host: Column) -> Column:
    """Whether a host is a literal address (or localhost) that must not be fetched. Names are resolved, and judged again, where they are fetched."""
    number = ipv4_number(host)
    inside = F.lit(False)
    for first, bits in BLOCKED_V4:
        low = int(ipaddress.ip_address(first))
        inside = inside | number.between(low, low + 2 ** (32 - bits) - 1)
    plain = F.lower(F.regexp_replace(host, r"^\[|\]$", ""))
    six = F.contains(plain, F.lit(":")) & plain.rlike(BLOCKED_V6)
    return F.coalesce(inside, F.lit(False)) | F.coalesce(six | (plain == "localhost"), F.lit(False))


def url_allowed(url: Column, allowed_hosts: Sequence[str] = ()) -> Column:
    """Whether the policy lets a URL be fetched: http or https, a host, and that listed or not a blocked address."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    listed = host.isin(*allowed_hosts) if allowed_hosts else F.lit(False)
    return F.coalesce(url.rlike("^(?i)https?://") & host.isNotNull() & (listed | ~private_address(host)), F.lit(False))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """A value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


#: Schemes whose references are resolved; of others a reference stays as it is.
RELATIVE = ("http", "https", "ftp", "ws", "wss")


def url_parts(url: Column) -> Column:
    """scheme (lower case, empty for none), netloc, path, params (of the last segment), query and fragment, without blanks ahead and without line ends."""
    clean = F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]+", ""), "[\t\r\n]", "")

    def after_scheme(c: Column) -> Column:
        scheme = F.regexp_extract(c, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
        return F.struct(F.lower(scheme).alias("scheme"), F.when(scheme != "", F.substr(c, F.length(scheme) + 2)).otherwise(c).alias("rest"))

    def after_host(x: Column) -> Column:
        netloc = F.regexp_extract(x["rest"], "^//([^/?#]*)", 1)
        rest = F.when(F.startswith(x["rest"], F.lit("//")), F.substr(x["rest"], F.length(netloc) + 3)).otherwise(x["rest"])
        return F.struct(x["scheme"].alias("scheme"), netloc.alias("netloc"), rest.alias("rest"), F.regexp_extract(rest, "^([^?#]*)", 1).alias("hier"), F.regexp_extract(rest, "^([^#]*)", 1).alias("head"))

    def whole(x: Column) -> Column:
        path = F.regexp_extract(x["hier"], "^((?:.*/)?[^/;]*)", 1)
        later = lambda text, ahead: F.substr(text, F.length(ahead) + 2)
        return F.struct(x["scheme"].alias("scheme"), x["netloc"].alias("netloc"), path.alias("path"), later(x["hier"], path).alias("params"), later(x["head"], x["hier"]).alias("query"), later(x["rest"], x["head"]).alias("fragment"))

    return let(let(let(clean, after_scheme), after_host), whole)


def _resolved(base_path: Column, path: Column) -> Column:
    """The path of a reference against that of its base, dots and empty segments in between taken out."""
    parts = F.split(base_path, "/", -1)
    kept = F.when(F.element_at(parts, -1) != "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    joined = lambda s: F.concat(F.slice(s, 1, 1), F.filter(F.slice(s, F.lit(2), F.greatest(F.size(s) - 2, F.lit(0))), lambda x: x != ""), F.slice(s, F.size(s), F.lit(1)))
    segments = F.when(F.startswith(path, F.lit("/")), F.split(path, "/", -1)).otherwise(let(F.concat(kept, F.split(path, "/", -1)), lambda s: F.when(F.size(s) > 1, joined(s)).otherwise(s)))
    step = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.array_append(a, x))
    ended = lambda s: F.concat(F.aggregate(s, F.array().cast("array<string>"), step), F.when(F.element_at(s, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    return F.coalesce(F.nullif(let(segments, lambda s: F.array_join(ended(s), "/")), F.lit("")), F.lit("/"))


def _unparsed(scheme: Column, netloc: Column, path: Column, params: Column, query: Column, fragment: Column) -> Column:
    led = lambda mark, text: F.when(text != "", F.concat(F.lit(mark), text)).otherwise("")
    url = F.concat(path, led(";", params))
    rooted = F.startswith(url, F.lit("/"))
    at = F.when(netloc != "", F.concat(F.lit("//"), netloc, F.when((url != "") & ~rooted, "/").otherwise(""), url)).when((url == "") | rooted, F.concat(F.lit("//"), url)).otherwise(url)
    return F.concat(scheme, F.lit(":"), at, led("?", query), led("#", fragment))


def join_url(base: Column, reference: Column) -> Column:
    """A reference resolved against a base as the standard library's urljoin does it; null if either is null."""

    def resolved(x: Column) -> Column:
        b, r = x["b"], x["r"]
        other = ((r["scheme"] != "") & (r["scheme"] != b["scheme"])) | ~b["scheme"].isin(*RELATIVE)
        same = (r["path"] == "") & (r["params"] == "")
        return (
            F.when(other, x["reference"])
            .when(r["netloc"] != "", _unparsed(b["scheme"], r["netloc"], r["path"], r["params"], r["query"], r["fragment"]))
            .when(same, _unparsed(b["scheme"], b["netloc"], b["path"], b["params"], F.when(r["query"] == "", b["query"]).otherwise(r["query"]), r["fragment"]))
            .otherwise(_unparsed(b["scheme"], b["netloc"], _resolved(b["path"], r["path"]), r["params"], r["query"], r["fragment"]))
        )

    both = let(F.struct(url_parts(base).alias("b"), url_parts(reference).alias("r"), reference.alias("reference")), resolved)
    return F.when(base.isNull() | reference.isNull(), None).when(reference == "", base).when(base == "", reference).otherwise(both)
