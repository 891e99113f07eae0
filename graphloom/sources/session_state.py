"""Small state on the driver: counted questions with their hits, a writer's lock, checkpoint marks."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import time
from pathlib import Path

TTL = 24 * 3600.0
STALE = 600.0
MARK_BYTES, MARK_TTL = 8192, 3600.0


def fingerprint(question: str) -> str:
    return hashlib.sha1(question.strip().encode()).hexdigest()[:8]


def _write(path: Path, value) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}")
    part.write_text(json.dumps(value))
    os.replace(part, path)


class AskState:
    """How often each question came and what it found; entries expire ``TTL`` seconds after their last use."""

    def __init__(self, path: str):
        self.path = Path(path)

    def load(self, now: float) -> dict:
        try:
            own = json.loads(self.path.read_text())
        except (OSError, ValueError):
            own = {}
        return {k: v for k, v in own.items() if isinstance(v, dict) and now - v.get("last_at", 0) < TTL}

    def bump(self, question: str, now: float | None = None) -> int:
        now = time.time() if now is None else now
        own = self.load(now)
        entry = own.setdefault(fingerprint(question), {"count": 0, "hits": []})
        entry["count"], entry["last_at"] = entry["count"] + 1, now
        _write(self.path, own)
        return entry["count"]

    def record(self, question: str, ids: list[str], now: float | None = None, most: int = 3) -> None:
        now = time.time() if now is None else now
        own = self.load(now)
        entry = own.setdefault(fingerprint(question), {"count": 0, "last_at": now})
        entry["hits"] = ids[:most]
        _write(self.path, own)

    def recent(self, now: float | None = None, most: int = 15) -> list[str]:
        """Distinct hits, the latest question's first."""
        own = self.load(time.time() if now is None else now)
        ids = [i for e in sorted(own.values(), key=lambda e: -e["last_at"]) for i in e.get("hits", [])]
        return list(dict.fromkeys(ids))[:most]


def repeat_guidance(calls: int) -> str:
    return "excessive" if calls >= 3 else "repeated" if calls == 2 else "first"


@contextlib.contextmanager
def writer_lock(path: str, wait: float = 60.0, poll: float = 0.05):
    """One writer at a time; a lock of a dead process, or older than ``STALE`` seconds, is taken over."""
    until = time.time() + wait
    while True:
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            os.write(handle, json.dumps({"pid": os.getpid(), "at": time.time()}).encode())
            os.close(handle)
            break
        except FileExistsError:
            if _is_stale(path):
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(path)
                continue
            if time.time() > until:
                raise TimeoutError(f"{path} is held") from None
            time.sleep(poll)
    try:
        yield
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(path)


def _is_stale(path: str) -> bool:
    try:
        own = json.loads(Path(path).read_text())
        os.kill(own["pid"], 0)
        return time.time() - own["at"] > STALE
    except ProcessLookupError:
        return True
    except PermissionError:
        return False
    except FileNotFoundError:
        return True
    except (ValueError, KeyError):
        with contextlib.suppress(FileNotFoundError):
            return time.time() - os.path.getmtime(path) > 2
        return True


def first_action(text: str) -> str | None:
    """What follows ``next:``, or the next line that is not blank, without its bullet."""
    m = re.search(r"(?im)^[ \t>*#-]*next[ \t]*:[ \t]*(.*)$", text)
    if not m:
        return None
    lines = [m[1], *text[m.end() :].split("\n")]
    return next((re.sub(r"^\s*(?:[-*+]|\d+[.)])\s+", "", x).strip() for x in lines if x.strip()), None)


class CheckpointMark:
    """A note that is given back once, within ``MARK_TTL`` seconds and in the folder it was made in."""

    def __init__(self, path: str):
        self.path = Path(path)

    def mark(self, text: str, folder: str, now: float | None = None) -> str | None:
        if not text.strip():
            raise ValueError("an empty note")
        if len(text.encode()) > MARK_BYTES:
            raise ValueError(f"a note of over {MARK_BYTES} bytes")
        _write(self.path, {"text": text, "folder": folder, "at": time.time() if now is None else now})
        return first_action(text)

    def take(self, folder: str, now: float | None = None) -> str | None:
        now = time.time() if now is None else now
        try:
            own = json.loads(self.path.read_text())
        except (OSError, ValueError):
            return None
        if own.get("folder") != folder:
            return None
        self.path.unlink(missing_ok=True)
        return own["text"] if now - own["at"] <= MARK_TTL else None
