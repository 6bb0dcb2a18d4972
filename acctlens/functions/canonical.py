"""Canonical JSON, its digests, and the ids and fingerprints that are built from them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, is_dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ContractError


def canonical_json(value: Any) -> bytes:
    """UTF-8 JSON with sorted keys, no spaces and finite numbers only."""
    if is_dataclass(value) and not isinstance(value, type):
        value = asdict(value)
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()
    except (TypeError, ValueError) as e:
        raise ContractError("json") from e


def sha256_of(value: Any) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


#: What JSON escapes, the backslash first.
_ESCAPES = {c: json.dumps(c)[1:-1] for c in ["\\", '"', *map(chr, range(32))]}


def json_string(text: Column) -> Column:
    """The text as a canonical JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    escaped = text
    for c, to in _ESCAPES.items():
        escaped = F.replace(escaped, F.lit(c), F.lit(to))
    inner = F.when(F.regexp_like(text, F.lit(r'["\\\x00-\x1f]')), escaped).otherwise(text)
    return F.concat(F.lit('"'), inner, F.lit('"'))


def message_key(game: Column, message: Column) -> Column:
    """A message's identity: the JSON list of its game and its id."""
    return F.concat(F.lit("["), json_string(game), F.lit(","), json_string(message), F.lit("]"))


def atomic_id(kind: str, account: Column, owner: Column, keys: Column) -> Column:
    """kind-SHA256 of the JSON list of account, owner (JSON already: a number or a string) and keys (an array of texts)."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(keys, json_string), ","), F.lit("]"))
    whole = F.concat(F.lit("["), json_string(account), F.lit(","), owner, F.lit(","), listed, F.lit("]"))
    return F.concat(F.lit(f"{kind}-"), F.sha2(whole.cast("binary"), 256))
