"""Plain-Python versions of the operators' contracts, for small tables."""
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UP, LOW)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
       "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+",
       "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c)
        s += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return s % 10 == 0


def pii(text):
    text, out = text or "", []
    for kind, rx in PII.items():
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out
