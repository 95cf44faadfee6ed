"""Masking, pseudonyms, keyed hashes and canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of fields that never leave unmasked.
MASKED_FIELDS = (
    "password", "full_name", "dob", "date_of_birth", "id_number", "address", "email", "phone", "ssn", "passport_number", "national_id", "access_token",
    "refresh_token", "authorization", "mfa_code", "totp_code", "recovery_code", "secret", "password_hash",
)
MASK = "***"


def masked(df: DataFrame, fields: Iterable[str] = MASKED_FIELDS) -> DataFrame:
    """Every column whose name, in any case, is a masked field becomes the mask, nulls too."""
    names = {f.lower() for f in fields}
    return df.select(*[F.lit(MASK).alias(c) if c.lower() in names else F.col(f"`{c}`") for c in df.columns])


def masked_map(c: Column, fields: Iterable[str] = MASKED_FIELDS) -> Column:
    return F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(*fields), F.lit(MASK)).otherwise(v))


def hmac_sha256(key: bytes, c: Column) -> Column:
    """Hex HMAC-SHA-256 of a string, by the two nested digests of the definition."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in block).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(c, "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def sql_functions() -> list[str]:
    """hmac_sha256(key, value) for SQL; both are strings, the digest is lower-case hex."""
    pad = lambda x: f"unhex(array_join(transform(sequence(1, 127, 2), i -> lpad(hex(CAST(conv(substr(k, i, 2), 16, 10) AS INT) ^ {x}), 2, '0')), ''))"
    block = "rpad(hex(if(octet_length(key) > 64, unhex(sha2(encode(key, 'UTF-8'), 256)), encode(key, 'UTF-8'))), 128, '0')"
    return [f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS STRING RETURN {body}" for head, body in (
        ("tessera_hmac_of(k STRING, value STRING)", f"sha2(concat({pad(0x5C)}, unhex(sha2(concat({pad(0x36)}, encode(value, 'UTF-8')), 256))), 256)"),
        ("hmac_sha256(key STRING, value STRING)", f"tessera_hmac_of({block}, value)"),
    )]


def casefolded(c: Column) -> Column:
    """Full case folding by the full mappings to upper and to lower case; dotless i, which has no folding, is kept aside."""
    raised = F.translate(F.upper(F.translate(c, "ıẞ", "\ue000ß")), "\ue001", "")  # stands between, or the optimizer drops upper
    return F.translate(F.lower(raised), "ς\ue000", "σı")


def blind_index(key: bytes, c: Column) -> Column:
    """A keyed hash of the trimmed, case-folded value; null stays null."""
    return hmac_sha256(key, casefolded(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Sorted keys, no blanks, ASCII escapes, nulls kept; text that is no JSON gives null."""

    def one(t):
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return text.map(one)


def minimal_payload(hits: Column, alias: Column, tier: Column, birth: Column, remarks: Column) -> Column:
    """What may go to an outside model: alias, birth year, remarks cut to 160, the three best hits with scores to 1 digit."""
    best = F.transform(F.slice(hits, 1, 3), lambda h: F.struct(h["name"].alias("name"), F.round(h["score"], 1).alias("score")))
    return F.struct(alias.alias("alias"), tier.alias("tier"), F.year(F.try_to_date(birth)).alias("birth_year"), F.substring(remarks, 1, 160).alias("remarks"), best.alias("hits"))


def template_summary(alias: Column, tier: Column, name: Column, score: Column) -> Column:
    top = F.concat(F.lit("Case "), alias, F.lit(", tier "), tier, F.lit(". Top match: "), name, F.lit(" (score "), score.cast("string"), F.lit(")."))
    return F.coalesce(top, F.concat(F.lit("Case "), alias, F.lit(", tier "), tier, F.lit(". No screening hits recorded.")))
