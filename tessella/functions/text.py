"""Column functions: tokens, normalisation, identifiers, URLs, redaction."""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessella.functions.addresses import digits, let, reachable

#: The search and chunk token patterns, in classes on which Java, RE2 and Python agree.
SEARCH_RE = r"[\x{3400}-\x{9fff}]|[A-Za-z0-9_]+|[\p{L}\p{Nl}\p{No}]+"
CHUNK_RE = SEARCH_RE + r"|[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Key fragments whose values are never shown.
SENSITIVE = ("authorization", "body", "content", "cookie", "credential", "key", "password", "secret", "token")
RUN_ID_RE, VERSION_RE = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$", r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"


def search_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(SEARCH_RE), F.lit(0)), casefold)


def casefold(text: Column) -> Column:
    """Case folding for Latin text; exact_casefold for all of Unicode."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(StringType())
def exact_casefold(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def collapse(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)


def request_hash(*parts: Column) -> Column:
    joined = [x for p in parts for x in (F.lit("\0"), p.cast("string"))][1:]
    return F.sha2(F.concat(*joined), 256)


def uuid5(name: Column) -> Column:
    """Version-5 UUID of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


#: scheme, userinfo, host (bracketed or not), port, path, query
URL_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def url_part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.btrim(url), URL_RE, k)


def normal_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, userinfo or fragment; an empty path is a slash."""
    scheme, port, path, query = F.lower(url_part(url, 1)), url_part(url, 4), url_part(url, 5), url_part(url, 6)
    standard = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    return F.concat(scheme, F.lit("://"), F.lower(url_part(url, 3)), F.when(standard, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


@F.pandas_udf(StringType())
def joined_url(base: pd.Series, reference: pd.Series) -> pd.Series:
    """Where a redirect leads: a reference as seen from a page's address; null if either is or they can't be joined."""

    def one(b: str | None, r: str | None) -> str | None:
        try:
            return None if b is None or r is None else urljoin(b, r)
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, reference)])


def iso_text(at: Column) -> Column:
    """A UTC time to the second as ISO 8601."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_time(text: Column) -> Column:
    """An ISO 8601 time, with Z, an offset or neither (then UTC), as UTC without zone; null if it is none."""
    whole = F.regexp_extract(F.btrim(text), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)(?:[Zz]|([+-])([0-9]{2}):?([0-9]{2}))?$", 0)
    part = lambda k: F.regexp_extract(whole, r"^([0-9-]{10})[Tt ]([0-9:.]+)(?:[Zz]|([+-])([0-9]{2}):?([0-9]{2}))?$", k)
    minutes = F.when(part(3) == "", 0).otherwise((part(4).try_cast("int") * 60 + part(5).try_cast("int")) * F.when(part(3) == "-", -1).otherwise(1))
    return F.concat_ws(" ", part(1), part(2)).try_cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def hostname(url: Column) -> Column:
    host = F.btrim(F.lower(url_part(url, 3)), F.lit("[]"))
    return F.when(host != "", host).otherwise("Web source")


def web_target(url: Column) -> Column:
    """Whether a URL may be fetched by its form: http(s), a host, no userinfo, and no literal address that isn't globally reachable."""

    def allowed(host: Column) -> Column:
        literal = digits(F.btrim(host, F.lit("[]")))
        return (host != "") & (host != "localhost") & F.when(F.startswith(host, F.lit("[")), literal.isNotNull()).otherwise(F.lit(True)) & F.coalesce(reachable(literal), F.lit(True))

    return F.lower(url_part(url, 1)).isin("http", "https") & (url_part(url, 2) == "") & ~F.contains(url_part(url, 0), F.lit("@")) & let(F.lower(url_part(url, 3)), allowed)


def etag_version(etag: Column) -> Column:
    """n of W/"n", if it is 1 or more."""
    n = F.regexp_extract(etag, r'^(?:W/)?"([0-9]{1,9})"$', 1)
    return F.when((n != "") & (F.try_to_number(n, F.lit("999999999")) >= 1), n.cast("int"))


def _hidden(value, key: str = ""):
    if any(x in key.lower() for x in SENSITIVE):
        return "[REDACTED]"
    if isinstance(value, dict):
        return {k: _hidden(v, k) for k, v in value.items()}
    return [_hidden(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def redact(text: pd.Series) -> pd.Series:
    """JSON with the values of sensitive keys replaced at any depth, compact, characters as they are."""
    return text.map(lambda t: json.dumps(_hidden(json.loads(t)), ensure_ascii=False, separators=(",", ":")), na_action="ignore")


@F.pandas_udf(StringType())
def canonical_json_hash(text: pd.Series) -> pd.Series:
    """SHA-256 of JSON with sorted keys, compact, in ASCII."""
    return text.map(lambda t: hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")).encode()).hexdigest(), na_action="ignore")


def utf8_sig(content: Column) -> Column:
    """Bytes as UTF-8 text without a byte-order mark; null if they are no UTF-8."""
    text = F.try_validate_utf8(content.cast("string"))
    return F.when(F.startswith(text, F.lit("\ufeff")), F.substring(text, 2, 2**31 - 2)).otherwise(text)


def utc_second(at: Column) -> Column:
    return F.date_trunc("second", at)


def consented(consents: Column, user: Column, run: Column, provider: Column, category: Column) -> Column:
    """Whether some consent (allowed, user_id, run_id, provider, categories) covers a use."""
    return F.exists(consents, lambda c: c["allowed"] & (c["user_id"] == user) & (c["run_id"] == run) & (c["provider"] == provider) & F.array_contains(c["categories"], category))


def index_version(chunking: Column, provider: str, base_url: str, model: str, dimension: int, normalization: str, metric: str) -> Column:
    parts = [F.lit(x) for x in (provider, base_url, model, str(dimension), normalization, metric)]
    return F.concat(F.lit(f"dense-{provider}-"), F.substring(stable_id(*parts, chunking), 1, 24))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def collection_name(version: Column) -> Column:
    return F.concat(F.lit("dense_"), F.substring(F.sha2(version, 256), 1, 24))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
