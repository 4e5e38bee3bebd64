"""Small parsers: keys in paths, addresses, and command lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_from_path(path: Column, prefix: str) -> Column:
    """What follows a path's prefix, empty if nothing does."""
    return F.when(F.length(path) > len(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise("")


def with_port(address: Column, port: int) -> Column:
    """host:port of an address that may have a scheme, a port and a path."""
    bare = F.regexp_replace(address, "^https?://(?=.)", "")
    host = F.regexp_extract(bare, "^(.[^/:]*)", 1)
    return F.concat(host, F.lit(f":{port}"))


def split_words(line: str) -> list[str]:
    """Words of a command line: quotes hold blanks, and outside them a backslash
    takes the next character as it is."""
    words, word, quoted, escaped = [], "", False, False
    for c in line:
        if escaped:
            word, escaped = word + c, False
        elif c == "\\" and not quoted:
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif c == " " and not quoted:
            words, word = (words + [word] if word else words), ""
        else:
            word += c
    return words + [word] if word else words
