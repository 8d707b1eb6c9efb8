"""Unified diffs: file changes, hunks and their lines."""

from __future__ import annotations

import re

HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
KINDS = {" ": "Context", "+": "Added", "-": "Removed"}


class PatchError(ValueError):
    """Text that is no patch."""


def without_trailer(text: str) -> str:
    """Cut what follows a ``--`` line if the next line isn't blank (compatibility rule).

    The rule is fixed by the results it must equal: it also cuts at a removed line that
    starts with ``- ``, and after the first of several mails.
    """
    lines = text.splitlines(keepends=True)
    for i, line in enumerate(lines[:-1]):
        bare = line.rstrip("\r\n")
        if (bare == "--" or bare.startswith("-- ")) and lines[i + 1].strip():
            return "".join(lines[: i + 1])
    return text


def _side(path: str) -> str:
    path = path.split("\t")[0].strip().strip('"')
    return path[2:] if path[:2] in ("a/", "b/") else path


def parse(text: str, compat: bool = False) -> list[dict]:
    """File changes with hunks. Files without hunks, such as binary ones, are left out.

    Hunks are read by the counts in their headers, so text after them, such as a mail
    signature, is never mistaken for a removed line. With ``compat`` the trailer is cut by
    ``without_trailer`` first. Text without a file header, unless blank, is a PatchError.
    """
    lines = (without_trailer(text) if compat else text).split("\n")
    out: list[dict] = []
    i, headers = 0, 0
    while i < len(lines):
        line = lines[i].rstrip("\r")
        if line.startswith("--- ") and i + 1 < len(lines) and lines[i + 1].startswith("+++ "):
            headers += 1
            old, new = line[4:], lines[i + 1].rstrip("\r")[4:]
            i, hunks = _hunks(lines, i + 2)
            if not hunks:
                continue
            gone_old, gone_new = old.split("\t")[0].strip() == "/dev/null", new.split("\t")[0].strip() == "/dev/null"
            change = "Added" if gone_old else "Deleted" if gone_new else "Modified"
            out.append({"file_path": _side(old if gone_new else new), "change_type": change, "hunks": hunks})
        else:
            headers += line.startswith(("diff --git ", "Binary files "))
            i += 1
    if not headers and text.strip():
        raise PatchError("no file header found")
    return out


def _hunks(lines: list[str], i: int) -> tuple[int, list[dict]]:
    hunks = []
    while i < len(lines) and (m := HUNK.match(lines[i])):
        old_start, old_lines, new_start, new_lines = (int(x) if x is not None else 1 for x in m.groups())
        hunk = {"old_start": old_start, "old_lines": old_lines, "new_start": new_start, "new_lines": new_lines, "lines": []}
        i, old_left, new_left = i + 1, old_lines, new_lines
        while i < len(lines) and (old_left > 0 or new_left > 0):
            line = lines[i]
            mark = line[:1] or " "
            if mark == "\\":
                i += 1
                continue
            if mark not in KINDS or line.startswith(("diff --git ", "@@ ")):
                break
            hunk["lines"].append({"line_type": KINDS[mark], "content": line[1:].rstrip("\r")})
            old_left -= mark != "+"
            new_left -= mark != "-"
            i += 1
        if i < len(lines) and lines[i].startswith("\\"):
            i += 1
        hunks.append(hunk)
    return i, hunks
