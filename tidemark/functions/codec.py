"""Encodings: internal keys, fixed-width integers, varints, checksums, and how values and secrets are shown."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def big_endian(value: Column, width: int) -> Column:
    """A non-negative integer as `width` bytes."""
    return F.unhex(F.lpad(F.hex(value), 2 * width, "0"))


def from_big_endian(data: Column) -> Column:
    return F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")


def internal_key(key: str = "key", seq: str = "seq", op: str = "op") -> Column:
    """key, then the sequence number in eight bytes and the operation in one."""
    return F.concat(F.col(key), big_endian(F.col(seq).cast("long"), 8), big_endian(F.col(op).cast("long"), 1))


def split_internal_key(encoded: str) -> list[Column]:
    n = f"octet_length({encoded})"
    return [
        F.expr(f"substring({encoded}, 1, {n} - 9)").alias("key"),
        F.conv(F.hex(F.expr(f"substring({encoded}, {n} - 8, 8)")), 16, 10).cast("long").alias("seq"),
        F.conv(F.hex(F.expr(f"substring({encoded}, {n}, 1)")), 16, 10).cast("int").alias("op"),
    ]


def compare_internal(a: str, b: str) -> Column:
    """-1, 0 or 1 of two structs (key, seq, op) in canonical order."""
    x, y = F.col(a), F.col(b)
    return (
        F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1)
        .when(x["seq"] > y["seq"], -1).when(x["seq"] < y["seq"], 1)
        .when(x["op"] > y["op"], -1).when(x["op"] < y["op"], 1)
        .otherwise(0)
    )


def varint_length(value: str) -> Column:
    """Bytes of the LEB128 form: one for every seven bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("long")


def encode_varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | 0x80 if n else low)
        if not n:
            return bytes(out)


def decode_varint(data: bytes, canonical: bool = False) -> int:
    """The first varint of `data`; canonical: a longer form than needed is an error."""
    n = 0
    for i, b in enumerate(data[:10]):
        n |= (b & 0x7F) << (7 * i)
        if not b & 0x80:
            if n >> 64:
                raise ValueError("varint overflows 64 bits")
            if canonical and i and not b:
                raise ValueError("overlong varint")
            return n
    raise ValueError("truncated varint")


def varint(value: str) -> Column:
    """A whole number, read as 64 bits without a sign, as LEB128: seven bits a byte, lowest first, the high bit where more follow."""
    last = f"(cast(ceil(length(bin({value})) / 7) as int) - 1)"
    each = f"lpad(hex((shiftrightunsigned({value}, 7 * i) & 127) + if(i < {last}, 128, 0)), 2, '0')"
    return F.when(F.col(value).isNotNull(), F.unhex(F.expr(f"array_join(transform(sequence(0, {last}), i -> {each}), '')")))


def checksum(data: str) -> Column:
    """CRC-32 (IEEE) of bytes."""
    return F.crc32(data)


def redacted(key: str = "key") -> Column:
    return F.format_string("[REDACTED len=%d]", F.octet_length(key))


def show(value: bytes) -> str:
    """A value as a terminal shows it: printable text as it is, anything else quoted with escapes, an empty value as two quotes."""
    if not value:
        return '""'
    try:
        text = value.decode()
    except UnicodeDecodeError:
        text = None
    if text is not None and not re.search("\r(?!\n)", text) and all(c in "\n\t\r " or unicodedata.category(c)[0] in "LMNPS" for c in text):
        return text
    named = {34: '\\"', 92: "\\\\", 10: "\\n", 13: "\\r", 9: "\\t"}
    return '"' + "".join(named.get(b) or (chr(b) if 32 <= b < 127 else f"\\x{b:02x}") for b in value) + '"'


@F.pandas_udf(T.StringType())
def shown(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else show(bytes(v)))


def masked(secret: str) -> Column:
    """A secret as its length and six digits of its SHA-256."""
    s = F.trim(F.regexp_replace(secret, r"^\s+|\s+$", ""))
    return F.when(F.length(s) == 0, "[EMPTY]").otherwise(F.format_string("***[REDACTED len=%d sha256=%s]***", F.octet_length(s), F.substring(F.sha2(s, 256), 1, 6)))


# What makes a name sensitive once it is written in snake case: parts that count anywhere, words between underscores,
# words that count at the end, and words that count where the underscores are left out.
SENSITIVE_PARTS = (
    "password passwd pass_word passphrase secret credential private_key privatekey api_key apikey master_key masterkey signing_key signingkey "
    "encryption_key encryptionkey access_key accesskey authorization sessionid cookie mnemonic"
).split()
SENSITIVE_WORDS = "pwd session card cvv cvc ssn salt nonce seed auth".split()
SENSITIVE_ALONE = "pass pwd token auth session card cvv cvc ssn salt nonce seed".split()
REDACTED = "[REDACTED]"
# Fixed value: a sensitive name with its value in running text.
SENSITIVE_TEXT = (
    r"(?i)((?:^|[^A-Za-z0-9]))(password|passwd|pass|pwd|passphrase|secret|token|credential|credentials|api_key|apikey|private_key|privatekey|"
    r"secret_key|signing_key|encryption_key|master_key|access_key|authorization|auth_token|access_token|refresh_token|cookie|set_cookie|session|"
    r"session_id|sessionid|cvv|cvc|ssn|salt|nonce|mnemonic|seed)\b\s*[:=]\s*([^\s,;\"'}{]+)"
)
BEARER_TEXT = r"(?i)\b(Bearer\s+)([^\s,;\"'}{]+)"

_STEPS = (
    (r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "_"),
    (r"[-.:/\\\[\](){} \t_@#$%^&*=+|~`<>?!]+", "_"),
    (r"^_+|_+$", ""),
)
_NAME = (
    "|".join(SENSITIVE_PARTS)
    + rf"|(^|_)({'|'.join(SENSITIVE_WORDS)})(_|$)"
    + r"|(^|_)token$|^pass$|_pass(_|$)"
)
_STRIPPED = rf"password|passwd|^({'|'.join(SENSITIVE_ALONE)})$"


def snake_case(name: Column) -> Column:
    """A name in lower case with one underscore for every change from small to capital letter and every run of separators."""
    name = F.regexp_replace(name, r"^\s+|\s+$", "")
    for pattern, to in _STEPS:
        name = F.regexp_replace(name, pattern, to)
    return F.regexp_replace(F.lower(name), "_+", "_")


def sensitive(name: Column) -> Column:
    """Whether a log must not show the value of this name: `authToken`, `API-Key` and `user.pwd`, but not `author`."""
    snake = snake_case(name)
    return snake.rlike(_NAME) | F.regexp_replace(snake, "_", "").rlike(_STRIPPED)


def scrubbed(fields: str) -> Column:
    """A map with the values of sensitive names replaced, and sensitive text in the others."""
    return F.transform_values(fields, lambda k, v: F.when(sensitive(k), REDACTED).otherwise(scrubbed_text(v)))


def scrubbed_text(text: Column) -> Column:
    """Running text with the values of `name=value`, `name: value` and bearer tokens replaced."""
    return F.regexp_replace(F.regexp_replace(text, SENSITIVE_TEXT, f"$1$2={REDACTED}"), BEARER_TEXT, f"$1{REDACTED}")


def _is_sensitive(name: str) -> bool:
    snake = regex.sub(r"^\s+|\s+$", "", name)
    for pattern, to in _STEPS:
        snake = regex.sub(pattern, to, snake)
    snake = regex.sub("_+", "_", snake.lower())
    return bool(re.search(_NAME, snake) or re.search(_STRIPPED, snake.replace("_", "")))


def scrub_nested(value: object, depth: int = 0) -> object:
    """The same for nested dictionaries, lists and texts, 32 levels deep at the most."""
    if depth > 32:
        return REDACTED
    if isinstance(value, dict):
        return {k: REDACTED if _is_sensitive(str(k)) else scrub_nested(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [scrub_nested(v, depth + 1) for v in value]
    if isinstance(value, str):
        return re.sub(BEARER_TEXT, rf"\1{REDACTED}", re.sub(SENSITIVE_TEXT, rf"\1\2={REDACTED}", value))
    return value
