"""Signed, compressed bundles of a fact log, to move it between machines."""

from __future__ import annotations

import hashlib
import hmac
import json
import zlib

from corvane.operators.memory import canonical

TAG, MOST_BYTES = b"corvane-bundle-1\0", 256 * 1024 * 1024


def export(repository: str, branch: str, operations: list[dict], blobs: dict[str, str], purged: list[str], key: bytes) -> str:
    """Canonical JSON with an HMAC-SHA256 under a key of 32 bytes or more."""
    if len(key) < 32:
        raise ValueError("the key needs 32 bytes")
    body = {"version": 1, "repository": repository, "branch": branch, "operations": operations, "blobs": blobs, "purged": sorted(purged)}
    return canonical(body | {"signature": hmac.new(key, TAG + canonical(body).encode(), hashlib.sha256).hexdigest()})


def verify(text: str, repository: str, key: bytes) -> dict:
    body = json.loads(text)
    signature = body.pop("signature", "")
    if not hmac.compare_digest(signature, hmac.new(key, TAG + canonical(body).encode(), hashlib.sha256).hexdigest()):
        raise ValueError("the signature doesn't fit")
    if body.get("version") != 1 or body.get("repository") != repository:
        raise ValueError("another version or repository")
    for digest, payload in body["blobs"].items():
        if hashlib.sha256(payload.encode()).hexdigest() != digest:
            raise ValueError("a payload doesn't fit its checksum")
    return body


def merge_into(known: list[dict], body: dict, purged: list[str]) -> tuple[list[dict], dict[str, str], list[str]]:
    """(operations, payloads, purged) of both sides: parents before children, unknown parents refused, forgotten facts without payload."""
    gone = sorted({*purged, *body["purged"]})
    out, there = list(known), {o["id"] for o in known}
    for op in body["operations"]:
        if op["id"] in there:
            continue
        if any(p not in there for p in op["parents"]):
            raise ValueError("an operation lacks its parent")
        out.append(op)
        there.add(op["id"])
    dead = {o["payload_hash"] for o in out if o.get("fact_id") in gone}
    return out, {d: p for d, p in body["blobs"].items() if d not in dead}, gone


def compress(text: str) -> bytes:
    return zlib.compress(text.encode(), 9)


def decompress(data: bytes, most: int = MOST_BYTES) -> str:
    """Refuses truncated data, data with a tail, and more than `most` bytes."""
    d = zlib.decompressobj()
    out = d.decompress(data, most + 1)
    if len(out) > most:
        raise ValueError("too large")
    if not d.eof or d.unused_data:
        raise ValueError("truncated or with a tail")
    return out.decode()
