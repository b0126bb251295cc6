"""Credentials embedded in source code, located and redacted.

Method: rules find values by their place (assignment to a secret name, address with user and password, authorization
header, call, SQL clause, comment) or by their own form (issued tokens, private keys).  Literals that decode from base64,
base32, hex, percent, entity or escape layers are decoded, again and again until nothing decodes (every layer is shorter
than what it was read from), and the result is scanned by the same rules; bytes that decode are parsed as key containers by their binary grammar (DER sequences of private keys, the OpenSSH container).  A
hit inside decoded text stands for the enclosing encoded literal, which is redacted as a whole, so that the surrounding
code keeps its form: quotes, line ends and the alphabet of an encoding stay as they are.

What counts as a value depends on its place: behind the name of a password any text that is no reference, mask or
placeholder counts, a word or a phrase as well; elsewhere a value must not read like a plain name.  All rules take time in
proportion to the text, whatever the length of its lines.

Empty and masked values, placeholders, references to variables or vaults, encrypted values, public keys, digests, ids and
plain names are none.  A null or empty source has no credential.  Lines are counted from 1 and end with LF or CRLF.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import lexer

# fixed values: words of names that hold a secret, alone or before "key"; words behind them that make it something else
_SECRET = {"password", "passwd", "passphrase", "pass", "pwd", "pw", "secret", "token", "apikey", "credential", "credentials", "passcode"}
_BEFORE_KEY = {"api", "access", "signing", "master", "private", "encryption", "client", "auth", "hmac", "webhook", "shared", "secret", "service", "account", "crypto", "license", "storage", "x"}
_OTHERWISE = {
    "policy", "uri", "url", "ref", "name", "length", "min", "max", "serializer", "deserializer", "label", "ttl", "id", "type", "count", "expiry", "field", "header", "file", "path",
    "error", "message", "msg", "title", "text", "prompt", "property", "prop", "param", "parameter", "attribute", "attr", "rule", "rules", "changed", "at", "date", "reset", "strength", "confirmation", "valid",
    "alias", "hash", "public", "tokens", "provider", "endpoint", "size", "limit", "timeout", "format", "hint", "placeholder", "prefix", "enabled", "required", "column", "encoder", "service", "store", "pattern", "regex", "env", "var", "version",
}
_PASSWORD = {"password", "passwd", "passphrase", "pass", "pwd", "pw", "passcode"}
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

# fixed values: forms of tokens that name their issuer
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{16,}|glpat-[\w-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[\w-]{16,}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{16,}\.[\w-]{16,}|AIza[\w-]{35}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})(?![A-Za-z0-9_])"
)
_LITERAL = r"""(?:(?:[rRbBuUfF]{1,2}|[@$])?(?:\"\"\"[^"\r\n]+\"\"\"|'''[^'\r\n]+'''|"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*'))"""
_HINT = re.compile(r"pass|pw|secret|token|key|credential")
_NAME = re.compile(r"[\w.\-]*")
_SEP = r"""\\?["']?[ \t]*(?:(?::[ \t]*[A-Z][\w<>?]*[ \t]*)?=(?![=>])|:(?!:)|=>)[ \t]*"""
# a short prefix of lower-case letters, perhaps a number, and a long body of both cases and digits: how issuers write their tokens
_PREFIXED = re.compile(r"(?<![A-Za-z0-9_.\-/+])[a-z]{2,8}[._\-](?:[A-Za-z0-9]{4,16}[._\-])?(?P<body>[A-Za-z0-9]{24,})(?![A-Za-z0-9_.\-/+=])")
_ASSIGN = re.compile(_SEP + rf"(?P<val>\(?\s*{_LITERAL})")
_BARE = re.compile(_SEP + r"""(?P<val>[^\s"'(;,<>`\\][^\s"']*)(?=[ \t]*(?:\r?$|[ \t](?:\#|//|--|;)|-->|["']))""", re.M)
_LINE = re.compile(r"""[ \t]*[:=][ \t]*(?P<val>[^\s"'(;,<>`{\[|>&*!%@][^\r\n"'#]*?)[ \t]*(?:[ \t]\#[^\r\n]*)?\r?$""", re.M)
_LEAD = re.compile(r"[ \t]*(?:(?:export|ENV|ARG|-|\#+)[ \t]+|\#)*")
_ESCAPED_QUOTES = re.compile(r"""[ \t]*[:=][ \t]*\\"(?P<val>(?:[^"\\\r\n]|\\[^"])+)\\\"""")
_BREAK = re.compile(rf"""(?:[ \t]*:[ \t]*[A-Z][\w?]*)?[ \t]*=[ \t]*\(?[ \t]*\r?\n[ \t]*(?P<val>{_LITERAL})""")
_CONT = re.compile(r"""[ \t]*(?:\+|\\)?[ \t]*\r?\n[ \t]*(?:\+[ \t]*)?("(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')""")
_CALL = re.compile(r"""\(\s*(?:"(?P<k1>[\w.\-]+)"|'(?P<k2>[\w.\-]+)')\s*,\s*(?P<val>"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')""")
_LITERALS = re.compile(r""""(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*'""")
_LOGIN = re.compile(r"""(?:\b(?:connect|getConnection|login|authenticate|createConnection|credentials|basicAuth|setBasicAuth)\s*\(|\bauth\s*=\s*\()(?P<args>(?:[^()\r\n"']|"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*'|\((?:[^()\r\n"']|"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')*\))*)""")
_CHARS = re.compile(r"""(?P<val>"(?:[^"\\\r\n]|\\.)+"|'(?:[^'\\\r\n]|\\.)+')\.(?:toCharArray|encode|getBytes|toByteArray)\(""")
_KEYSTORE = re.compile(r"""(?i)\bkey_?store\w*\.load\(\s*[\w.]+\s*,\s*(?P<val>"(?:[^"\\\r\n]|\\.)+"|'(?:[^'\\\r\n]|\\.)+')""")
_SCHEMES = re.compile(r"(?<![\w+.\-])[A-Za-z][\w+.\-]*://")
_USERINFO = re.compile(r"""[^\s@"'<>]*""")
_QUERY = re.compile(r"""(?i)[?&](?P<key>sig|signature|api_?key|access_?token|auth_?token|token|key|secret|password|passwd|pwd|client_secret|auth)=(?P<val>[^&\s"'#<>]+)""")
_SCHEME = re.compile(r"""\b(?P<kind>[bB]asic|BASIC|[bB]earer|BEARER)[ \t]+(?P<val>[A-Za-z0-9+/_.~\-]{8,}={0,2})""")
_USER = re.compile(r"""(?:\s-u[ \t]*|\s--user[ =])["']?(?P<user>[\w.\-]+):(?P<val>[^\s"']+)""")
_SQL = re.compile(r"""(?i)\b(?:password|identified[ \t]+by)[ \t]+(?P<val>'(?:[^'\r\n]|'')+')""")
_INSERT = re.compile(r"""(?i)\binsert\s+into\s+[\w."]+\s*\((?P<cols>[^()]*)\)\s*values\s*(?P<rows>\((?:[^()']|'(?:[^']|'')*'|\([^()']*\))*\)(?:\s*,\s*\((?:[^()']|'(?:[^']|'')*'|\([^()']*\))*\))*)""")
_INSIDE = re.compile(r"""(?i)(?<![\w.\-])(?P<key>password|passwd|pwd|secret|token)=(?P<val>[^\s"'&;,)]+)""")
_XML = re.compile(r"""(?i)\bname\s*=\s*["'](?P<key>[\w.\-]+)["']\s+value\s*=\s*(?P<val>"[^"\r\n]*"|'[^'\r\n]*')""")
_ELEMENT = re.compile(r"""<(?P<key>[A-Za-z][\w.\-]*)>(?P<val>[^<>\r\n]+)</(?P=key)>""")
_NAMED = re.compile(r"""(?m)^[ \t#/*]*-?[ \t]*name:[ \t]*["']?(?P<key>[\w.\-]+)["']?[ \t]*\r?\n[ \t#]*value:[ \t]*(?P<val>[^\r\n]+)""")
_SECRET_WORD = re.compile(r"(?<!\w)(?:парол[ьи]|pw|pwd|passwd|password|passwort|kennwort|contrase[nñ]a|clave|mot[ ]de[ ]passe|login|credentials?|creds|secret|token|api[ _-]?key|ключ|логин)(?!\w)")
_MARK = re.compile(r"//|\#|--|/\*|\*|<!--")
_BEGIN = re.compile(r"-----BEGIN (?P<label>(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
_KEY_LINES = re.compile(r"""(?:(?:\s|\\[nrt]|["'+#*])*[A-Za-z0-9+/]{16,}={0,2}(?=[\s"'\\]|$))*(?:(?:\s|\\[nrt]|["'+#*])*[A-Za-z0-9+/]{1,64}={1,2}(?=[\s"'\\]|$))?""")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/=_\-])(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9_\-]{16,}={0,2})(?![A-Za-z0-9+/=_\-])")
_BASE32 = re.compile(r"[A-Z2-7]{16,}={0,6}")
_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{2}){12,}(?![0-9A-Za-z])")
_ESCAPE = re.compile(r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\[0-3][0-7]{2}|%[0-9a-fA-F]{2}|&\#(?:[0-9]{2,7}|[xX][0-9a-fA-F]{2,6});")
_RUN = re.compile(r"[^\s\"']*")

_REFERENCE = re.compile(r"""(?ix)^(?:\$\{ | \$\( | \$[A-Za-z_] | \{\{ | \#\{ | %\( | %[A-Za-z_]+% | %s$ | @[A-Za-z.]+@$ | <[^<>]*>?$ | \[[^\]]*\]$ | vault[:/] | secret[s]?[:/] | ref\+?: | arn:aws:(?:secretsmanager|ssm) | projects/ | op:// | kms: | \{cipher\} | enc\( | enc: | ENC\[ | \{noop\}$ | \{bcrypt\} | \$2[aby]\$ | \$argon | \$5\$ | \$6\$ | sha(?:1|256|512)[:$-] | md5[:$-] | \{(?:ssha|sha|md5|pbkdf2)\} | -----BEGIN | data: | classpath: | file: | https?:// | ssh-(?:rsa|ed25519) )""")
_PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|change[-_ ]?(?:me|it|this)\w*|your[-_ ].*|my[-_ ]?(?:password|secret|token|key)|todo.*|tbd|fixme.*|dummy.*|place[-_ ]?holder.*|example.*|sample|insert[-_ ].*|replace[-_ ].*|redacted|removed|hidden|masked|none|null|nil|undefined|true|false|default|empty|secret|password|token|n/?a|unset|not[-_ ]set|test|foo|bar|foobar)$")
_PLAIN = re.compile(r"^(?:[A-Za-zА-Яа-яё]+|[a-z]+(?:[-_./:][a-z]+)*|[A-Z]+(?:_[A-Z]+)*|[a-z]+(?:[A-Z][a-z]+)*|\d{1,5}|[\d.]+)$")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")


def secret_name(name: str, header: bool = False) -> bool:
    """Whether a variable, key or column of this name holds a secret."""
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts:
        return False
    for i, part in enumerate(parts):
        hit = part in _SECRET or (part == "key" and i > 0 and (parts[i - 1] in _BEFORE_KEY or header))
        if hit and not (set(parts[i + 1 :]) & _OTHERWISE) and "public" not in parts[:i] and not (part == "token" and parts[:i] and parts[i - 1] in ("max", "min", "num", "next", "page")):
            return True
    return False


def _password_name(name: str) -> bool:
    """Whether a name is that of a password, behind which any text is one."""
    parts = [p.lower() for p in _PART.findall(name)]
    return bool(parts) and parts[-1] in _PASSWORD


def usable(value: str, strict: bool = False, password: bool = False) -> bool:
    """Whether a literal value could be a credential in use.

    ``strict`` also demands the look of a generated one; ``password`` says that the place is that of a password, where
    words, phrases and short values count too.
    """
    v = value.strip()
    if not v or len(set(v)) <= 2:
        return False
    if _REFERENCE.match(v) or _PLACEHOLDER.match(v) or _UUID.match(v):
        return False
    if re.search(r"\$\{[^}]*\}|\{\{[^}]*\}\}", v) or re.search(r"\*{3,}|•{3,}|\.{3,}", v):
        return False
    if password:
        # text about a password is none: it names the thing, ends like a sentence or is the path of a property
        return not (_SECRET_WORD.search(v.lower()) or re.search(r"[\s][\s\S]*[.:!?]$", v) or re.fullmatch(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+|[A-Z]+(?:_[A-Z]+)+", v))
    if re.search(r"\s", v) or _PLAIN.match(v):
        return False
    if strict:
        return len(v) >= 8 and bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v)) and not re.match(r"^[\w.\-]+\(.*\)?;?$", v)
    return True


def _inner(start: int, literal: str) -> tuple[int, int, str]:
    """(start, end, text) inside the quotes of a literal that may stand behind a bracket and a prefix."""
    skip = len(literal) - len(literal.lstrip("( \t\r\nrRbBuUfF@$"))
    width = 3 if literal[skip : skip + 3] in ('"""', "'''") and len(literal) - skip >= 6 else 1
    return start + skip + width, start + len(literal) - width, literal[skip + width : len(literal) - width]


def _length(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 0 < n <= 4 or at + 1 + n > len(data):
        raise ValueError("length")
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n


def _fields(data: bytes, at: int, end: int) -> list[tuple[int, bytes]]:
    out = []
    while at < end:
        tag = data[at]
        size, body = _length(data, at + 1)
        if body + size > end:
            raise ValueError("field")
        out.append((tag, data[body : body + size]))
        at = body + size
    return out


def private_container(data: bytes) -> bool:
    """Whether bytes are an unencrypted private key: PKCS#1, PKCS#8, SEC1 or the OpenSSH container."""
    try:
        if data.startswith(b"openssh-key-v1\x00"):
            size = int.from_bytes(data[15:19], "big")
            return data[19 : 19 + size] == b"none"
        if len(data) < 32 or data[0] != 0x30:
            return False
        size, body = _length(data, 1)
        if body + size > len(data):
            return False
        parts = _fields(data, body, body + size)
        tags = [t for t, _ in parts]
        if len(parts) >= 9 and tags[:9] == [2] * 9:
            return True
        if len(parts) >= 3 and tags[:3] == [2, 0x30, 4] and int.from_bytes(parts[0][1], "big") <= 1:
            return _fields(parts[1][1], 0, len(parts[1][1]))[0][0] == 6
        return len(parts) >= 2 and tags[:2] == [2, 4] and parts[0][1] == b"\x01" and len(parts[1][1]) in range(20, 80)
    except (ValueError, IndexError):
        return False


def _layers(token: str) -> Iterator[bytes]:
    """Bytes that a token may encode."""
    if _HEX.fullmatch(token):
        yield binascii.unhexlify(token)
    if _BASE64.fullmatch(token):
        body = token.rstrip("=")
        if len(body) % 4 != 1:
            try:
                yield base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
            except binascii.Error:
                pass
    if _BASE32.fullmatch(token):
        body = token.rstrip("=")
        try:
            yield base64.b32decode(body + "=" * (-len(body) % 8))
        except binascii.Error:
            pass
    if _ESCAPE.search(token):
        text = re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m.group(1) or m.group(2), 16)), token)
        text = re.sub(r"\\([0-3][0-7]{2})", lambda m: chr(int(m.group(1), 8)), text)
        if "&#" in text:
            text = html.unescape(text)
        if "%" in text:
            text = urllib.parse.unquote(text, errors="replace")
        yield text.encode("utf-8", "surrogatepass")


def _escaped(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs without blanks and quotes that hold at least four escapes, from their first escape on."""
    at = 0
    while m := _ESCAPE.search(text, at):
        end = _RUN.match(text, m.start()).end()
        n = 0
        for _ in _ESCAPE.finditer(text, m.start(), end):
            n += 1
        if n >= 4:
            yield m.start(), end
        at = max(end, m.end())


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if len(text) >= 8 and all(c.isprintable() or c in "\t\r\n" for c in text) else None


def _basic(value: str) -> bool:
    for data in _layers(value) if len(value) >= 16 else [base64.b64decode(value + "=" * (-len(value) % 4))]:
        text = _readable(data) or ""
        user, colon, rest = text.partition(":")
        if colon and rest and usable(rest):
            return True
    return False


def find(text: str, config: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every credential value, without overlaps, in order.

    ``config``: a configuration file, in which a value needs no quotes.
    """
    hits: dict[int, tuple[int, str]] = {}

    def add(start: int, end: int, kind: str) -> None:
        if start not in hits or hits[start][0] < end:
            hits[start] = (end, kind)

    _plain_rules(text, add, config)
    tokens = [m.span() for pattern in (_BASE64, _HEX) for m in pattern.finditer(text)]
    if "\\" in text or "%" in text or "&#" in text:
        tokens += _escaped(text)
    for start, end in tokens:
        token = text[start:end]
        for data in _layers(token):
            if private_container(data):
                add(start, end, "private_key")
                continue
            inner = _readable(data)
            if inner and len(inner) < len(token) and find(inner, config):
                add(start, end, "encoded")
    out: list[tuple[int, int, str]] = []
    for start in sorted(hits):
        end, kind = hits[start]
        if out and start < out[-1][1]:
            if end > out[-1][1] and kind != "encoded":
                out[-1] = (out[-1][0], end, out[-1][2])
            continue
        out.append((start, end, kind))
    return out


def _joined(text: str, end: int, value: str) -> tuple[str, int]:
    """A literal with those that continue it on the following lines."""
    while m := _CONT.match(text, end):
        value += m.group(1)[1:-1]
        end = m.end()
    return value, end


def _private_keys(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the key blocks; one without its end goes as far as lines of the key's alphabet follow."""
    absent: set[str] = set()
    for m in _BEGIN.finditer(text):
        mark = f"-----END {m.group('label')}-----"
        other, stop = text.find("-----BEGIN ", m.end()), -1 if mark in absent else text.find(mark, m.end())
        if stop < 0:
            absent.add(mark)
        closed = stop >= 0 and not 0 <= other < stop
        stop = stop if closed else _KEY_LINES.match(text, m.end()).end()
        body = text[m.end() : stop]
        if "ENCRYPTED" not in m.group("label") and "ENCRYPTED" not in body and any(len(set(run)) > 4 for run in re.findall(r"[A-Za-z0-9+/]{16,}", body)):
            yield m.start(), stop + (len(mark) if closed else 0)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the password in addresses of the form scheme://user:password@host."""
    dead = 0
    for m in _SCHEMES.finditer(text):
        if m.end() < dead:
            continue  # a run without @ was read before
        end = _USERINFO.match(text, m.end()).end()
        user = re.match(r"[^/:]*", text[m.end() : end]).end()
        if text[end : end + 1] != "@":
            dead = end
        elif user + 1 < end - m.end() and text[m.end() + user] == ":" and re.match(r"[\w\[]", text[end + 1 : end + 2]):
            yield m.end() + user + 1, end


def _names(text: str, lower: str) -> Iterator[tuple[str, int]]:
    """(name, end) of every name that holds a secret."""
    done = 0
    for m in _HINT.finditer(lower):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "_.-"):
            start -= 1
        while text[start] in "-." or text[start].isdigit():
            start += 1
        end = done = max(_NAME.match(text, m.start()).end(), m.end())
        name = text[start:end]
        if secret_name(name):
            yield name, end


def _lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else re.sub("[A-ZА-Я]+", lambda m: m.group().lower(), text)


def _remarks(text: str, lower: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the last word of comment lines that name a secret before it: ``mark .. name [..] [:=/] value``."""
    at = 0
    while word := _SECRET_WORD.search(lower, at):
        begin = text.rfind("\n", 0, word.start()) + 1
        end = text.find("\n", word.end())
        end = len(text) if end < 0 else end
        line = re.sub(r"[ \t]*(?:\*/|-->)?[ \t\r]*$", "", text[begin:end])
        at = end + 1
        mark = _MARK.search(line)
        tail = line.rsplit(None, 1)
        if not mark or len(tail) < 2:
            continue
        head, value = line[: len(line) - len(tail[1])], tail[1]
        glued = re.match(r"(?i).*?(?<!\w)(?:pw|pwd|passwd|password|secret|token|creds|login|пароль|ключ)[:=](?=[^:=/])", value)
        if glued:
            head, value = head + glued.group(), value[glued.end() :]
        bare = head.rstrip()
        if bare.endswith("/") and not glued:
            bare = bare[:-1].rstrip()
            bare = bare[: len(bare) - len(re.search(r"[\w.\-@]*$", bare).group())].rstrip()
        bare = re.sub(r"[:=/]$", "", bare)
        behind = max(bare.rfind(c) for c in ":=/")
        last = None
        for last in _SECRET_WORD.finditer(_lowered(bare), behind + 1):
            pass
        if last and last.start() >= mark.end() and not re.search("[\"'<>]", value):
            yield begin + len(head), begin + len(head) + len(value)


def _plain_rules(text: str, add, config: bool) -> None:
    lower = _lowered(text)
    for m in ISSUED.finditer(text):
        if len(set(m.group())) > 6:
            add(m.start(), m.end(), "token")
    for m in _PREFIXED.finditer(text):
        body = m.group("body")
        if len(set(body)) > 10 and all(re.search(c, body) for c in ("[a-z]", "[A-Z]", "[0-9]")):
            add(m.start(), m.end(), "token")
    if "PRIVATE KEY" in text:
        for start, end in _private_keys(text):
            add(start, end, "private_key")
    run_end = 0  # names inside a run whose value was read before are part of that value
    for name, at in _names(text, lower):
        password = _password_name(name)
        if m := _ASSIGN.match(text, at) or _BREAK.match(text, at):
            start, end, value = _inner(m.start("val"), m.group("val"))
            whole, stop = _joined(text, m.end("val"), value)
            if value and usable(whole, password=password) and not _lookup(whole):
                add(start, end if stop == m.end("val") else stop - 1, "assigned")
        elif at >= run_end and (m := _BARE.match(text, at)):
            run_end = m.end("val")
            value = m.group("val").rstrip(";,")
            if usable(value) and not _lookup(value) and _bare(value):
                add(m.start("val"), m.start("val") + len(value), "assigned")
        elif m := _ESCAPED_QUOTES.match(text, at):
            if usable(m.group("val"), password=password) and not _lookup(m.group("val")):
                add(m.start("val"), m.end("val"), "assigned")
        run_end = max(run_end, _RUN.match(text, at).end() if at >= run_end else 0)
        if config and password and (m := _LINE.match(text, at)):
            line = text.rfind("\n", 0, at) + 1
            if _LEAD.match(text, line).end() == at - len(name) and usable(m.group("val"), password=True) and not _lookup(m.group("val")) and _bare(m.group("val")):
                add(m.start("val"), m.end("val"), "assigned")
    for m in _CALL.finditer(text):
        key = m.group("k1") or m.group("k2")
        if secret_name(key, header=key.upper().startswith("X-")):
            start, end, value = _inner(m.start("val"), m.group("val"))
            if usable(value):
                add(start, end, "argument")
    for m in _LOGIN.finditer(text) if "(" in text else ():
        found = [(m.start("args") + x.start(), x.group()) for x in _LITERALS.finditer(m.group("args"))]
        if len(found) >= 2:
            start, end, value = _inner(*found[-1])
            if usable(value, strict=True) and "://" not in value:
                add(start, end, "login")
    for pattern in (_CHARS, _KEYSTORE) if "keystore" in lower or "key_store" in lower else ():
        for m in pattern.finditer(text):
            start, end, value = _inner(m.start("val"), m.group("val"))
            if usable(value, strict=True):
                add(start, end, "key_store")
    if "://" in text:
        for start, end in _addresses(text):
            if usable(urllib.parse.unquote(text[start:end])):
                add(start, end, "address")
    for m in _QUERY.finditer(text):
        if usable(m.group("val"), strict=True) or (_password_name(m.group("key")) and usable(m.group("val"), password=True) and _bare(m.group("val"))):
            add(m.start("val"), m.end("val"), "query")
    for m in _SCHEME.finditer(text) if "basic" in lower or "bearer" in lower else ():
        value = m.group("val")
        try:
            good = _basic(value) if m.group("kind").lower() == "basic" else usable(value, strict=True)
        except (binascii.Error, ValueError):
            good = False
        if good:
            add(m.start("val"), m.end("val"), "authorization")
    for m in _USER.finditer(text):
        if usable(m.group("val")):
            add(m.start("val"), m.end("val"), "user")
    if "password" in lower or "identified" in lower:
        for m in _SQL.finditer(text):
            if usable(m.group("val")[1:-1]):
                add(m.start("val") + 1, m.end("val") - 1, "sql")
    if "insert" in lower:
        for m in _INSERT.finditer(text):
            columns = [c.strip(' "\r\n\t') for c in m.group("cols").split(",")]
            for row in re.finditer(r"\(((?:[^()']|'(?:[^']|'')*'|\([^()']*\))*)\)", m.group("rows")):
                cells = list(re.finditer(r"'(?:[^']|'')*'|(?:[^,'()]|\([^()']*\))+", row.group(1)))
                cells = [c for c in cells if c.group().strip()]
                for name, cell in zip(columns, cells):
                    at = m.start("rows") + row.start(1) + cell.start()
                    if cell.group().startswith("'") and secret_name(name) and usable(cell.group()[1:-1]):
                        add(at + 1, at + len(cell.group()) - 1, "sql")
    for m in _INSIDE.finditer(text) if "=" in text else ():
        if usable(m.group("val"), strict=True) and _bare(m.group("val")):
            add(m.start("val"), m.end("val"), "parameter")
    if "<" in text:
        for m in _XML.finditer(text):
            if secret_name(m.group("key")) and usable(m.group("val")[1:-1]):
                add(m.start("val") + 1, m.end("val") - 1, "xml")
        for m in _ELEMENT.finditer(text):
            if secret_name(m.group("key")) and usable(m.group("val")):
                add(m.start("val"), m.end("val"), "xml")
    if "value:" in text:
        for m in _NAMED.finditer(text):
            value = m.group("val").strip()
            quoted = len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]
            body = value[1:-1] if quoted else value
            name = m.group("key")
            if (secret_name(name) and usable(body)) or (name.upper().endswith("_KEY") and usable(body, strict=True) and _generated(body)):
                start = m.start("val") + m.group("val").index(value) + quoted
                add(start, start + len(body), "assigned")
    for start, end in _remarks(text, lower):
        value = text[start:end]
        if usable(value, strict=True) and "://" not in value and _generated(value):
            add(start, end, "remark")


def _lookup(value: str) -> bool:
    """Whether the text of a literal names a variable or a place rather than a value."""
    return bool(re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[a-z]+(?:\.[a-z_]+){2,}|/[\w./-]+", value))


def _bare(value: str) -> bool:
    """Whether unquoted text can be a value: no call, index, member access or type."""
    return not re.search(r"[()\[\]{}|\\]|^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$|::|->|=>", value)


def _generated(value: str) -> bool:
    return bool(re.search(r"[!#%*=+$^&@_\-.]", value) or (re.search(r"[a-z]", value) and re.search(r"[A-Z]", value)) or re.fullmatch(r"[0-9a-f]{16,}", value))


def _cover(value: str, kind: str) -> str:
    """What stands in place of a value, in the alphabet of its encoding and with its line ends."""
    if kind == "private_key" and "-----BEGIN" in value:
        head, _, rest = value.partition("-----BEGIN ")
        label, _, body = rest.partition("-----")
        inner, dashes, tail = body.partition("-----END")
        lines = re.split(r"(\r?\n|\\[nrt])", inner)
        for k in range(0, len(lines), 2):
            if ":" not in lines[k]:  # the headers of a block stay
                mark = re.match(r"\s*(?://+|#+|\*+|--)?(?=\s|$)", lines[k])
                at = mark.end() if mark else 0
                lines[k] = lines[k][:at] + re.sub(r"[A-Za-z0-9+/=]+", lambda m: m.group() if m.group() == "+" else "A" * len(m.group()), lines[k][at:])
        return head + "-----BEGIN " + label + "-----" + "".join(lines) + dashes + tail
    if kind in ("encoded", "authorization", "private_key"):
        if _HEX.fullmatch(value):
            return b"REDACTED".hex()
        if "%" not in value and "\\" not in value and "." not in value:
            return base64.b64encode(b"user:REDACTED").decode()
    return "REDACTED"


def redact(text: str, hits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in hits:
        value = text[start:end]
        if "\n" in value and kind != "private_key":
            # a literal continued over lines: every part is emptied, the first takes the mark
            first = re.match(r"""[^"'\r\n]*""", value).group()
            rest = re.sub(r"""(["'])([^"'\r\n]*)(?=["']|$)""", lambda m: m.group(1) + ("" if m.start() else m.group(2)), value[len(first) :])
            parts = re.split(r"""(\r?\n)""", rest)
            rest = "".join(re.sub(r"""(^[^"']*["'])[^"']*""", r"\1", p) if k else p for k, p in enumerate(parts))
            out += [text[at:start], "REDACTED", rest]
        else:
            out += [text[at:start], _cover(value, kind)]
        at = end
    return "".join(out) + text[at:]


def locate(nodes: DataFrame, with_text: bool = False) -> DataFrame:
    """(node_id, line_no, kind), one row per line on which a value begins; or (node_id, n_found, redacted) per node.

    Repeated rows of a node count once.  Nodes without source give no row.
    """
    if with_text:
        fields = [("node_id", pa.int64()), ("n_found", pa.int32()), ("redacted", pa.string())]
    else:
        fields = [("node_id", pa.int64()), ("line_no", pa.int32()), ("kind", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            for node, text, path, lang in zip(*(c.to_pylist() for c in batch.columns)):
                hits = find(text, lexer.family(path, lang, text) == "hash")
                if with_text:
                    values = [(node, len(hits), redact(text, hits))]
                else:
                    values = [(node, text.count("\n", 0, start) + 1, kind) for start, _, kind in hits]
                for value in values:
                    for column, x in zip(rows, value):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, fields)], schema=schema)

    for name in ("file_path", "lang"):
        nodes = nodes if name in nodes.columns else nodes.withColumn(name, F.lit(None).cast("string"))
    sources = nodes.select("id", "source_code", "file_path", "lang").where("id is not null and source_code is not null and source_code <> ''")
    found = sources.mapInArrow(run, "node_id long, n_found int, redacted string" if with_text else "node_id long, line_no int, kind string")
    return found.dropDuplicates(["node_id"]) if with_text else found.distinct()
