"""The words that the sender of a raw mail wrote in it."""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re

_HEADER = re.compile(r"^[A-Za-z][A-Za-z0-9\-]*\s*:")
_BREAKS = re.compile(r"\r\n?| | |\x0b|\x0c|\x85")
_BOUNDARY = re.compile(r"boundary\s*=\s*(?:\"([^\"]+)\"|([^\s;]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w\-]+)", re.I)
_ENCODED = re.compile(r"=\?([\w\-]+)\?([bBqQ])\?([^?]*)\?=")
_DROP = re.compile(r"(?is)<(style|script|head|title)\b.*?(?:</\1\s*>|$)|<!--.*?-->")
_QUOTES = re.compile(r"(?i)<(/?)blockquote\b[^>]*>")
_NEWLINE = re.compile(r"(?i)<\s*(?:br|/p|/div|p|div|/tr|/li|pre|/pre|hr|/h\d)\b[^>]*>")
_TAG = re.compile(r"<[^<>]{0,2000}>")
#: A line between rules or dashes that opens a forwarded or quoted mail.
_FORWARD = re.compile(r"^\s*[-_=]{3,}\s*[^\W\d_][^\n]{3,60}?\s*[-_=]{3,}\s*$|^\s*Begin forwarded message", re.I)
_FROM = re.compile(r"^\s*\*?(?:From|Von|De|Da|Van)\*?\s*:\*?\s", re.I)
_FIELD = re.compile(r"^\s*\*?(?:Sent|Date|To|Subject|Gesendet|Datum|An|Betreff|Envoyé|À|Objet|Enviado|Fecha|Para|Asunto|Data|Inviato|Oggetto|Onderwerp)\*?\s*:", re.I)
_RULE = re.compile(r"^\s*(?:--|—|_{3,}|\*{5,}|={5,}|-{5,}|~{3,})\s*$")
_QUOTED = re.compile(r"^\s*(?:>|\||&gt;)")
_CLOCK = re.compile(r"\d{1,2}:\d{2}")
_WROTE = re.compile(r"\b(?:wrote|writes|schrieb|écrit|escribió|escreveu|scrisse|schreef)\b", re.I)
_OPENS = re.compile(r"^\s*(?:On|Am|Le|El|Em|Il|Op)\s.{0,40}\d")
_GREETING = re.compile(r"^\s*(?:dear|hello|hi|hey|hallo|hoi|good (?:morning|afternoon|evening|day)|bonjour|salut|hola|buenos días|olá|ciao|guten tag|liebe[rs]?|sehr geehrte\w*|greetings|to whom)\b[^.?]{0,45}$", re.I)
_CALLED = re.compile(r"^\s*[^\W\d_][\w'\-]*(?:\s[^\W\d_][\w'\-]*)?\s*,\s*$")
_CLOSE = re.compile(
    r"^\s*(?:(?:with |many |my )?(?:best|kind|warm|kindest|warmest)?\s*(?:regards|wishes|thanks|greetings)|best|cheers|thanks(?: again)?|thank you|sincerely(?: yours)?|yours(?: \w+)?|cordialement|bien à vous|amicalement|"
    r"(?:viele |liebe |beste |schöne )?gr(?:u|ü)(?:ß|ss)e?n?|mit freundlichen grüßen|(?:un |muchos )?saludos?|atentamente|abraços?|mfg|lg|vg)\s*[,.!]*\s*$",
    re.I,
)
_NOTICE = re.compile(
    r"^\s*(?:(?:note|notice|confidentiality notice|disclaimer|hinweis|avis|aviso)\s*:|.{0,40}\b(?:message|e-?mail|mail|nachricht|mensaje|correo|correspondence|communication)\b.{0,80}\b(?:confidential|privileged|vertraulich|confidentiel|confidencial|disclaim|addressee|liability|obligation|exclusively)|"
    r"(?:the )?(?:views|opinions)\b.{0,60}\bexpressed|please consider the environment|no contractual obligation|registered office|if you (?:have received|are not the intended))",
    re.I,
)
_CONTACT = re.compile(r"^\s*(?:(?:tel|phone|mob|mobile|cell|fax|t|m)\b[.:]?\s*[\d+(]|☎|<mailto:|\S+(?:@| \(at\) )\S+\s*$|born \d|https?://\S+\s*$)", re.I)
_MACHINE = re.compile(r"(?i)\b(?:no-?reply|do-?not-?reply|mailer-daemon|postmaster|daemon|cron|runner|build|jenkins|ci|bot|notifications?|alerts?|monitor(?:ing)?|automat\w*|system)\b")
_LOG = re.compile(r"^\s*(?:(?:ok|skip|fail|error|warn(?:ing)?|info|pass(?:ed)?|debug)\b\s+\S|\[[^\]]+\]\s|\d{4}-\d\d-\d\d[ T]|build \d+)", re.I)
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_SOFT = re.compile(r"[ \t]*\n")


def _decode(raw: bytes, charset: str) -> str:
    for c in ("utf-8", charset, "windows-1252"):
        try:
            return raw.decode(c)
        except (LookupError, UnicodeDecodeError):
            pass
    return raw.decode("latin-1")


def _word(m: re.Match) -> str:
    try:
        raw = base64.b64decode(m[3] + "=" * (-len(m[3]) % 4)) if m[2] in "bB" else quopri.decodestring(m[3].replace("_", " ").encode())
    except (binascii.Error, ValueError):
        return m[0]
    return _decode(raw, m[1])


def _headers(text: str) -> tuple[dict[str, str], str]:
    """Header fields by lower-case name (the first of each) and the body. Without any, the whole text is the body."""
    lines = text.split("\n")
    at, fields, last = 0, {}, None
    while at < len(lines) and not lines[at].strip() and at < 3:
        at += 1
    if at < len(lines) and lines[at].startswith("From "):
        at += 1
    begin = at
    while at < len(lines):
        line = lines[at]
        if not line.strip():
            break
        if line[0] in " \t" and last is not None:
            fields[last] += " " + line.strip()
        elif _HEADER.match(line):
            name, _, value = line.partition(":")
            last = name.strip().lower()
            last = last if last not in fields else f"{last} (again)"
            fields[last] = value.strip()
        else:
            break
        at += 1
    if at == begin:
        return {}, text
    return fields, "\n".join(lines[at + 1 :] if at < len(lines) and not lines[at].strip() else lines[at:])


def _content(fields: dict[str, str], body: str) -> str:
    how = fields.get("content-transfer-encoding", "").strip().lower()
    m = _CHARSET.search(fields.get("content-type", ""))
    charset = m[1] if m else "utf-8"
    if how == "base64":
        packed = re.sub(r"[^A-Za-z0-9+/]", "", body)
        try:
            return _decode(base64.b64decode(packed[: len(packed) - (len(packed) % 4 == 1)] + "=" * (-len(packed) % 4 if len(packed) % 4 != 1 else 0)), charset)
        except (binascii.Error, ValueError):
            return ""
    if how == "quoted-printable":
        return _decode(quopri.decodestring(_SOFT.sub("\n", body).encode("utf-8", "replace")), charset)
    return body


def _parts(fields: dict[str, str], body: str, depth: int = 0) -> list[tuple[str, str]]:
    """(kind, text) of the text parts, attachments left out."""
    kind = fields.get("content-type", "text/plain").split(";")[0].strip().lower() or "text/plain"
    if "attachment" in fields.get("content-disposition", "").lower():
        return []
    if kind.startswith("multipart/") and depth < 6:
        m = _BOUNDARY.search(fields.get("content-type", ""))
        mark = "--" + (m[1] or m[2]) if m else None
        if mark is None or mark not in body:
            guess = re.search(r"(?m)^(--\S{5,70})[ \t]*\n(?:content-)", body, re.I)
            mark = guess[1] if guess else None
        if mark is None:
            return [("text/plain", _content({}, body))]
        out = []
        for piece in re.split(rf"(?m)^{re.escape(mark)}(?:--)?[ \t]*(?:\n|\Z)", body)[1:]:
            if piece.strip():
                out += _parts(*_headers(piece.lstrip("\n") if not piece.startswith("\n") else "\n" + piece.lstrip("\n")), depth + 1) if not piece.startswith("\n") else [("text/plain", piece)]
        return out
    if kind in ("text/html", "text/plain") or kind.startswith("text/"):
        return [("text/html" if kind == "text/html" else "text/plain", _BREAKS.sub("\n", _content(fields, body)))]
    return []


def _plain(text: str) -> str:
    """Text of HTML without what it quotes."""
    text = _DROP.sub(" ", text)
    out, depth, at = [], 0, 0
    for m in _QUOTES.finditer(text):
        if depth == 0:
            out.append(text[at : m.start()])
        depth = max(0, depth - 1) if m[1] else depth + 1
        at = m.end()
    if depth == 0:
        out.append(text[at:])
    return html.unescape(_TAG.sub(" ", _NEWLINE.sub("\n", "\n".join(out))))


def _bare(name: str) -> str:
    return " ".join(re.sub(r"[^\w\s\-]", " ", name).lower().split())


def _before_forward(lines: list[str]) -> list[str]:
    """The lines before a forwarded or quoted mail that is kept with its own header fields or under a title line."""
    for i, line in enumerate(lines):
        if _FORWARD.match(line) or _FROM.match(line) and any(_FIELD.match(x) for x in lines[i + 1 : i + 4]):
            return lines[:i]
    return lines


def _own_lines(text: str, sender: str) -> list[str]:
    lines = _before_forward(text.split("\n"))
    out: list[str] = []
    said = 0
    at = 0
    while at < len(lines):
        line = lines[at].replace("\xa0", " ").strip()
        if _QUOTED.match(line):
            at += 1
            continue
        if line:
            if line.endswith(":") and (_WROTE.search(line) or _CLOCK.search(line)):
                at += 1
                continue
            if _OPENS.match(line) or _CLOCK.search(line):  # an attribution over two or three lines
                both = line
                for more in range(1, 3):
                    if at + more < len(lines):
                        both += " " + lines[at + more].strip()
                        if both.endswith(":") and (_WROTE.search(both) or _CLOCK.search(both)) and len(both) < 220:
                            break
                else:
                    both = ""
                if both.endswith(":") and len(both) < 220:
                    at += more + 1
                    continue
            if _RULE.match(line):
                break
            if _NOTICE.match(line):
                while at < len(lines) and lines[at].strip():
                    at += 1
                continue
            if sender and _bare(line) == sender or _CLOSE.match(line):
                break
            if _CONTACT.match(line):
                at += 1
                continue
            if not said and (_GREETING.match(line) or _CALLED.match(line)):
                said = 1
                at += 1
                continue
            said = 1
        out.append(line)
        at += 1
    # after the end of the sender's text there may be answers between later quotes
    rest = lines[at:]
    if rest and any(_QUOTED.match(x) for x in rest):
        last = max(i for i, x in enumerate(rest) if _QUOTED.match(x))
        tail = rest[last + 1 :]
        if sum(len(x) for x in tail) > 0 and at + last + 1 < len(lines):
            out += _own_lines("\n".join(tail), sender)
    return out


def own_text(raw: str | None) -> tuple[str, bool]:
    """What the sender wrote in this mail, and whether the mail is an automatic report. Null and empty give an empty text.

    Transfer encodings are undone; left out are headers, greeting, quoted and forwarded text, signature, notices and
    attachments. Of a text in two forms the plain one counts.
    """
    if not raw or not raw.strip():
        return "", False
    fields, body = _headers(_BREAKS.sub("\n", raw.lstrip("﻿")))
    parts = _parts(fields, body)
    plain = "\n".join(t for k, t in parts if k == "text/plain")
    text = plain if WORD.search(plain) else "\n".join(_plain(t) for k, t in parts if k == "text/html")
    who = _ENCODED.sub(_word, fields.get("from", ""))
    name = _bare(who.split("<")[0]) if "<" in who else ""
    lines = _own_lines(text, name)
    spoken = [x for x in lines if x]
    logs = sum(1 for x in spoken if _LOG.match(x))
    auto = bool(spoken) and (logs > 0.5 * len(spoken) or bool(_MACHINE.search(who.split("@")[0])) and logs > 0.2 * len(spoken) or "auto-submitted" in fields and fields["auto-submitted"].lower() != "no")
    return "\n".join(lines).strip(), auto
