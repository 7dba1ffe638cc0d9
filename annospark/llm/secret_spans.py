"""Finding secrets in one text: fixed patterns, and strings that compression cannot explain."""

from __future__ import annotations

import re
from bisect import bisect_right

import zstandard

# The base patterns. Their matches do not overlap; those that are too short are dropped afterwards.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LONG_HEX = re.compile(r"[0-9a-f]{16}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]{16,}")
SENSITIVE = re.compile(
    r"secret|passw|token|api.?key|access.?key|private.?key|auth|bearer|credential|signature|session.?id|client.?id|webhook", re.I
)
CASES = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")
KEY_BODY = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----(.*?)(?:-----END|\Z)", re.S)
AROUND = 512  # code points on each side that prime the compressor

# What identifiers and settings are made of; a candidate that consists of these compresses well.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1111111111111111 ffffffffffffffff "
    "xxxxxxxxxxxxxxxx ________________ ---------------- ================ 12345678901234567890 abcdef0123456789 "
    "example placeholder changeme your-token-here your_api_key_here YOUR_SECRET_KEY insert-password-here redacted "
    "configuration settings environment variable production development staging application service account client "
    "server database connection username password hostname endpoint request response header authorization bearer "
    "authentication certificate signature session cookie credential private public access secret token webhook "
    "getAttribute setAttribute addEventListener createElement removeChild toString initialize constructor prototype "
    "application_default_credentials user_id client_id image_id created_at updated_at access_token refresh_token "
    "api_key secret_key private_key public_key access_key_id secret_access_key connection_string base_url file_path "
    "http://www.example.com/path/index.html https://localhost:8080/api/v1/users/ /usr/local/lib/python3/site-packages/ "
    "import from return function class self const static void string integer boolean null none true false undefined "
).encode()


def mixed_make(word: str) -> bool:
    """Whether a string has letters and digits, or letters that change case too often for words put together."""
    digits = any(c.isdigit() for c in word)
    letters = any(c.isalpha() for c in word)
    return letters and (digits or 3 * len(CASES.findall(word)) >= len(word))


class Places:
    """Which places of a text are sensitive.

    A block is a run of lines that are not blank. A line is sensitive if a sensitive word stands in its block, in the
    last line before the block, or in a line that encloses it by standing less indented above.
    """

    def __init__(self, text: str):
        self.starts, self.blocks, self.outer = [], [], []
        self.keys = [m.span(1) for m in KEY_BODY.finditer(text)]
        self.words: list[bool] = []  # of blocks
        above: list[tuple[int, bool]] = []  # enclosing lines: how far indented, whether sensitive or in a sensitive one
        at, last, blank = 0, False, True
        for line in text.split("\n"):
            bare = line.lstrip()
            outer = False
            if bare:
                here = SENSITIVE.search(line) is not None
                if blank:
                    self.words.append(last)
                self.words[-1] |= here
                far = len(line) - len(bare)
                while above and above[-1][0] >= far:
                    above.pop()
                outer = bool(above) and above[-1][1]
                above.append((far, here or outer))
                last = here
            blank = not bare
            self.starts.append(at)
            self.blocks.append(len(self.words) - 1)
            self.outer.append(outer)
            at += len(line) + 1

    def sensitive(self, start: int) -> bool:
        k = bisect_right(self.starts, start) - 1
        return self.words[self.blocks[k]] or self.outer[k]

    def in_key(self, start: int) -> bool:
        k = bisect_right(self.keys, start, key=lambda span: span[0]) - 1
        return k >= 0 and start < self.keys[k][1]


class SecretFinder:
    """Spans ``(kind, start, end, novelty)`` of a text, in code points with the end exclusive."""

    def __init__(self, least_novelty: float = 0.62, identifiers: bytes = IDENTIFIERS):
        self.least = least_novelty
        words = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=6, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)

    def novelty(self, text: str, start: int, end: int) -> float:
        """Bytes that the span adds to its compressed surroundings, for each byte it has."""
        context = (text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]).encode()
        span = text[start:end].encode()
        return max(0, len(self.packer.compress(context + b"\n" + span)) - len(self.packer.compress(context))) / len(span)

    def base(self, text: str) -> list[tuple[str, int, int]]:
        found, low = [], None
        if "=" in text or ":" in text:
            low = text.lower()
            if any(w in low for w in WORDS):
                found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        if "AKIA" in text:
            found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
        first = LONG_HEX.search(text)
        if first:
            found += [("hex", *m.span()) for m in HEX.finditer(text, first.start()) if m.end() - m.start() >= 16]
        return found

    def spans(self, text: str) -> list[tuple[str, int, int, float]]:
        base = self.base(text)
        taken = sorted((s, e) for _, s, e in base)
        more, at, reach = [], 0, 0  # base spans that start before the candidate's end, and how far they go
        places = None
        for m in CANDIDATE.finditer(text) if SENSITIVE.search(text) else ():
            start, end = m.span()
            while at < len(taken) and taken[at][0] < end:
                reach, at = max(reach, taken[at][1]), at + 1
            if reach > start:
                continue
            places = places or Places(text)
            if places.in_key(start) or mixed_make(m[0]) and places.sensitive(start):
                more.append(("novel", start, end))
        measured = [(*s, self.novelty(text, s[1], s[2])) for s in base + more]
        kept = [s for s in measured if s[0] != "novel" or s[3] >= self.least]
        return sorted(kept, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
