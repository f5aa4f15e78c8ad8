"""Registration of queries: a function per query, with its SQL where there is one."""

from __future__ import annotations

import unicodedata


class Book:
    def __init__(self):
        self.QUERIES: dict = {}

    def query(self, name: str, sql: str | None = None):
        def keep(f):
            self.QUERIES[name] = (f, sql)
            return f

        return keep


def sql_nfkc(expr: str) -> str:
    """SQL for the compatibility mapping of the blocks that the tables use, then composition."""
    one_from, one_to, many = "", "", []
    for a, b in ((0xA0, 0xFF), (0xE33, 0xE33), (0x2000, 0x206F), (0x2103, 0x2103), (0x2460, 0x2473), (0x2F00, 0x2FD5), (0x3000, 0x3000), (0x338F, 0x338F), (0xFF01, 0xFFEF)):
        for cp in range(a, b + 1):
            to = unicodedata.normalize("NFKC", chr(cp))
            if to == chr(cp) or unicodedata.normalize("NFC", chr(cp)) != chr(cp):
                continue
            if len(to) == 1:
                one_from += chr(cp)
                one_to += to
            else:
                many.append((chr(cp), to))
    out = f"translate({expr}, '{one_from}', '" + one_to.replace("'", "''") + "')"
    for a, b in many:
        if a in "…½¼¾㎏℃①②③ำ" or "0" <= b[0] <= "9":
            out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize({out})"
