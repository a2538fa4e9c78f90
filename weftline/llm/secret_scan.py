"""Secret scans with structural confirmation.

Base kinds are patterns whose matches count as they are: ``assign``, ``access`` and ``hex``. Further kinds are reported only if a
candidate's own structure confirms them: base64 or hex text is decoded and has to be a DER structure of a key (every nested length
fits exactly), an OpenSSH key (length-prefixed fields that fill it), or a signed token whose header is a JSON object that names an
algorithm. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _shared

#: Kinds in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "private_key", "public_key", "ssh_key", "signed_token")
# Case is spelled out: case-insensitive matching would also take letters that fold to ASCII.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = re.compile(rf"({_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})-----([A-Za-z0-9+/=\s\\]*)-----END \1-----")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{24,}={0,2}")
#: Base64 of "{" and any next byte, and what may follow from there on in the alphabet of tokens.
_HEAD = re.compile(r"e[w-z0-9+/_-]")
_TOKENS = tuple(re.compile(rf"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){{{n}}}") for n in (4, 2))
#: Base64 of a sequence's tag and length (24 bytes or more), and of the first field of an OpenSSH key.
_KEY = re.compile(r"M[B-I]|AAAA[BCE]|b3BlbnNzaC1rZXktdjEA")
_ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:0?[xX])?([0-9A-Fa-f]{48,})(?![0-9A-Za-z])")
_SSH = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
_SEQUENCE, _INTEGER, _BITS, _OCTETS, _OID, _NULL = 0x30, 0x02, 0x03, 0x04, 0x06, 0x05


def decode(text: str) -> bytes | None:
    """The bytes of base64 in either alphabet, padded or not; None if it isn't whole."""
    text = text.rstrip("=").translate({45: 43, 95: 47})
    if len(text) % 4 == 1 or "." in text:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, start: int, end: int, depth: int = 0) -> list[tuple[int, object]] | None:
    """(tag, content) of the elements that fill data[start:end] exactly, nested for constructed ones; None if any length is off."""
    out = []
    while start < end:
        if end - start < 2 or depth > 8 or len(out) > 64:
            return None
        tag, length, at = data[start], data[start + 1], start + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            length, at = int.from_bytes(data[at : at + n]), at + n
        if at + length > end or tag & 0x1F == 0x1F:
            return None
        content = der(data, at, at + length, depth + 1) if tag & 0x20 else data[at : at + length]
        if content is None:
            return None
        out.append((tag, content))
        start = at + length
    return out


def key_kind(data: bytes) -> str | None:
    """What key a DER encoding holds: its outermost sequence has to fill it and be made as RSA, EC, PKCS#8 or X.509 keys are."""
    if len(data) < 24 or data[0] != _SEQUENCE:
        return None
    top = der(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != _SEQUENCE:
        return None
    inner = top[0][1]
    tags = [t for t, _ in inner]
    if tags[:1] == [_INTEGER] and len(inner[0][1]) == 1 and inner[0][1][0] <= 1:
        if len(tags) >= 9 and set(tags[:9]) == {_INTEGER} and len(inner[1][1]) >= 32:
            return "private_key"  # RSA
        if tags[1:2] == [_OCTETS] and len(inner[1][1]) >= 24:
            return "private_key"  # EC
        if tags[1:3] == [_SEQUENCE, _OCTETS] and inner[1][1][:1] and inner[1][1][0][0] == _OID:
            return "private_key"  # PKCS#8
    if tags == [_SEQUENCE, _OCTETS] and inner[0][1][:1] and inner[0][1][0][0] == _OID and len(inner[1][1]) >= 32:
        return "private_key"  # encrypted PKCS#8
    if tags == [_SEQUENCE, _BITS] and inner[0][1][:1] and inner[0][1][0][0] == _OID:
        return "public_key"
    if tags == [_INTEGER, _INTEGER] and len(inner[0][1]) >= 64:
        return "public_key"  # RSA
    return None


def ssh_kind(data: bytes) -> str | None:
    """An OpenSSH key: a known first field, and fields whose lengths fill the data."""
    if data.startswith(b"openssh-key-v1\0"):
        fields, at = 0, 15
        while at + 4 <= len(data) and fields < 3:  # cipher, key derivation, its options
            at += 4 + int.from_bytes(data[at : at + 4])
            fields += 1
        if fields < 3 or at + 8 > len(data) or int.from_bytes(data[at : at + 4]) < 1:
            return None
        at += 4
        at += 4 + int.from_bytes(data[at : at + 4])  # the public key
        return "ssh_key" if at + 4 <= len(data) and at + 4 + int.from_bytes(data[at : at + 4]) == len(data) else None
    if len(data) < 32 or data[:3] != b"\0\0\0":
        return None
    at, fields = 0, []
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4])
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return "ssh_key" if at == len(data) and len(fields) >= 2 and fields[0] in _SSH else None


def is_signed_token(text: str) -> bool:
    """Three base64url parts, the first a JSON object that names its algorithm, the second one too or not JSON at all if encrypted."""
    parts = text.split(".")
    if len(parts) not in (3, 5) or not parts[0] or not parts[1]:
        return False
    head = decode(parts[0])
    if not head or head[:1] != b"{" or len(head) > 1 << 16:
        return False
    try:
        fields = json.loads(head)
    except (ValueError, RecursionError):
        return False
    if not isinstance(fields, dict) or not isinstance(fields.get("alg"), str):
        return False
    if len(parts) == 5:
        return "enc" in fields
    body = decode(parts[1])
    return body is not None and body[:1] == b"{" and (fields["alg"].lower() == "none" or bool(parts[2]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """assign, access and hex: whole matches, leftmost and non-overlapping within a kind, those too short dropped."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS] if "AKIA" in text else []
    # a run of hex digits matches from its first digit on, so long ones can be sought alone
    out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates that their structure confirms."""
    out, taken = [], []
    if "-----BEGIN " in text:
        for m in _BLOCK.finditer(text):
            data = decode(re.sub(r"\\[nr]|\s", "", m[2]))
            kind = data and (key_kind(data) or ssh_kind(data))
            if kind:
                out.append((kind, *m.span()))
                taken.append(m.span())
    block = 0
    for m in _RUN.finditer(text):
        while block < len(taken) and taken[block][1] <= m.start():
            block += 1
        if block < len(taken) and taken[block][0] <= m.start():
            continue
        run = m[0]
        tokens = _tokens(run)
        out += [("signed_token", m.start() + a, m.start() + b) for a, b in tokens]
        out += [(k, m.start() + a, m.start() + b) for k, a, b in _keys(run) if not any(x < b and a < y for x, y in tokens)]
    for m in _ANY_HEX.finditer(text):
        if len(m[1]) % 2 == 0 and m[1][:2] in ("30", "00", "6f", "6F"):
            data = bytes.fromhex(m[1])
            kind = key_kind(data) or ssh_kind(data)
            if kind:
                out.append((kind, *m.span(1)))
    return out


def _tokens(run: str) -> list[tuple[int, int]]:
    """Signed tokens that start anywhere in a run; one at its start may go on to its end, others end where their alphabet does, if they can."""
    out, at, last = [], 0, run.rfind(".")
    while at < last and (m := _HEAD.search(run, at, last)):
        at = m.start() + 1
        dot = run.find(".", m.start())
        # a header of more is none to is_signed_token(); its first bytes have to be "{" and white space, a quote or the zero of a wider code
        first = decode(run[m.start() : m.start() + 4]) if dot - m.start() >= 4 and dot - m.start() <= 90_000 else None
        if not first or first[:1] != b"{" or first[1] not in b" \t\r\n\"\0":
            continue
        rest = run[m.start() :]
        whole, strict = [rest, rest.rstrip(".")], [found[0] for p in _TOKENS if (found := p.match(rest))]
        for one in dict.fromkeys(strict + whole if m.start() else whole + strict):  # an unsigned token ends in a dot, and so may a sentence
            if is_signed_token(one):
                out.append((m.start(), m.start() + len(one)))
                at = m.start() + len(one)
                break
    return out


def _keys(run: str) -> list[tuple[str, int, int]]:
    """Keys in base64 that start anywhere between the dots of a run and end at the next one."""
    out, begin = [], 0
    for part in run.split("."):
        at = 0
        while m := _KEY.search(part, at):
            at = m.start() + 1
            if m[0][0] == "M":  # the length that the outermost sequence states is that of what is left
                head = decode(part[m.start() : m.start() + 8]) or b""
                if len(head) < 6:
                    continue
                n = head[1] & 0x7F
                size = 2 + n + int.from_bytes(head[2 : 2 + n]) if head[1] & 0x80 else 2 + n
                if size != len(part[m.start() :].rstrip("=")) * 3 // 4:
                    continue
            data = decode(part[m.start() :])
            kind = data and (key_kind(data) or ssh_kind(data))
            if kind:
                out.append((kind, begin + m.start(), begin + len(part)))
                break
        begin += len(part) + 1
    return out


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every stretch that spans cover replaced by ``[SECRET]``."""
    out, at = [], 0
    for _, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]]) if spans else text


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, one row per row of ``docs``.

    A null or empty text has no spans and the hash of the empty string. Repeated rows are scanned each, a null doc_id stays null,
    other columns aren't read, an empty table gives no rows.
    """
    _shared.prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in _shared.slices(batches):
            out = [[], [], [], [], []]
            for text in _shared.decoded(batch.column(1)):
                base = ordered(base_spans(text))
                kinds = [k for k, _, _ in base]
                row = (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(written(base).encode()).hexdigest(), written(ordered(base + confirmed_spans(text))))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.string()) for x in out[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[SECRET]``; all rows and columns stay.

    Spans that overlap are replaced as one. A null text stays null, an empty one empty; repeated rows and rows without doc_id are
    treated like others. ``n_chars``, if there is one, follows the text. An empty table stays empty.
    """
    _shared.prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in _shared.slices(batches):
            at = batch.schema.get_field_index("text")
            new = [None if t is None else redact(t.decode("utf-8", "replace"), ordered(base_spans(t.decode("utf-8", "replace")) + confirmed_spans(t.decode("utf-8", "replace")))) for t in _shared.texts_of(batch.column(at))]
            columns = [*batch.columns]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
