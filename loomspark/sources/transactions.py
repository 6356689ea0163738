"""Two-file writes that happen as a whole or not at all, with backups, a log, rollback and a lock. Driver only.

Every operation has a folder with backups and manifest.json under STATE/operations of the
project. Its status goes prepared, writing, completed, and rolled-back later; a failed
write is rolled-back-after-failure, or failed where even that went wrong.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import secrets
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path

STATE = ".loomspark"
#: Seconds after which a lock counts as left behind.
STALE = 600


class ApplyError(RuntimeError):
    """kind: conflict, invalid, locked, missing, unsafe-path or write."""

    def __init__(self, kind: str, reason: str):
        super().__init__(reason)
        self.kind = kind


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def inside(root: Path, rel_path: str) -> Path:
    """The file of a relative path; refuses paths out of the root, and links anywhere on the way."""
    parts = Path(rel_path).parts
    if not parts or Path(rel_path).is_absolute() or ".." in parts:
        raise ApplyError("unsafe-path", f"not inside the project: {rel_path}")
    at = root
    for part in parts:
        at = at / part
        if at.is_symlink():
            raise ApplyError("unsafe-path", f"a link: {rel_path}")
    return at


def with_line_ends_of(text: str, like: str) -> str:
    plain = text.replace("\r\n", "\n")
    return plain.replace("\n", "\r\n") if "\r\n" in like else plain


@contextlib.contextmanager
def lock(root: Path, stale: float = STALE) -> Iterator[None]:
    """Held by one process; a lock of a dead process, or an old one, is taken over."""
    path = root / STATE / "lock"
    path.parent.mkdir(parents=True, exist_ok=True)
    for attempt in range(2):
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            if attempt or not _left_behind(path, stale):
                raise ApplyError("locked", "another change is under way") from None
            path.unlink(missing_ok=True)
    token = f"{os.getpid()} {secrets.token_hex(8)}"
    os.write(handle, token.encode())
    os.close(handle)
    try:
        yield
    finally:
        with contextlib.suppress(FileNotFoundError):
            if path.read_text() == token:
                path.unlink()


def _left_behind(path: Path, stale: float) -> bool:
    try:
        if time.time() - path.stat().st_mtime > stale:
            return True
        os.kill(int(path.read_text().split()[0]), 0)
    except ProcessLookupError:
        return True
    except (FileNotFoundError, ValueError, IndexError, PermissionError):
        return False
    return False


def _replace(path: Path, data: bytes) -> None:
    part = path.with_name(f".{path.name}.{secrets.token_hex(4)}.tmp")
    try:
        with open(part, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    finally:
        part.unlink(missing_ok=True)


def _log(folder: Path, manifest: dict, status: str) -> None:
    manifest["status"] = status
    _replace(folder / "manifest.json", json.dumps(manifest, indent=2).encode())


def apply(root: str, source: str, target: str, new_source: str, new_target: str, *, expected_sha: str | None = None, check: Callable[[str, str], None] | None = None, hooks: dict[str, Callable[[], None]] | None = None) -> str:
    """Writes the new target file, then the changed source file; returns the operation's id.

    expected_sha: of the source as the change was planned on. check(rel_path, text) raises on texts that must not be
    written. hooks (after_target, after_source) are for failure tests. On any error both files are as before.
    """
    base, hooks = Path(root).resolve(), hooks or {}
    at_source, at_target = inside(base, source), inside(base, target)
    with lock(base):
        if not at_source.is_file():
            raise ApplyError("missing", f"no such file: {source}")
        if at_target.exists() or at_source == at_target:
            raise ApplyError("conflict", f"already there: {target}")
        old = at_source.read_bytes()
        if expected_sha not in (None, sha(old)):
            raise ApplyError("conflict", f"changed since it was planned: {source}")
        texts = {source: with_line_ends_of(new_source, old.decode("utf-8")), target: with_line_ends_of(new_target, old.decode("utf-8"))}
        for rel_path, text in texts.items():
            if check:
                try:
                    check(rel_path, text)
                except Exception as e:
                    raise ApplyError("invalid", f"{rel_path}: {e}") from e
        new = {k: v.encode() for k, v in texts.items()}
        name = f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{secrets.token_hex(3)}"
        folder = base / STATE / "operations" / name
        folder.mkdir(parents=True)
        (folder / "source.backup").write_bytes(old)
        if sha((folder / "source.backup").read_bytes()) != sha(old):
            raise ApplyError("write", "the backup differs from the file")
        manifest = {"id": name, "created_at": datetime.now(UTC).isoformat(), "source": source, "target": target, "source_before": sha(old), "source_after": sha(new[source]), "target_after": sha(new[target])}
        _log(folder, manifest, "prepared")
        try:
            at_target.parent.mkdir(parents=True, exist_ok=True)
            _log(folder, manifest, "writing")
            _replace(at_target, new[target])
            hooks.get("after_target", lambda: None)()
            _replace(at_source, new[source])
            hooks.get("after_source", lambda: None)()
            if sha(at_source.read_bytes()) != manifest["source_after"] or sha(at_target.read_bytes()) != manifest["target_after"]:
                raise ApplyError("write", "the files differ from what was written")
            _log(folder, manifest, "completed")
        except Exception as e:
            try:
                _replace(at_source, old)
                at_target.unlink(missing_ok=True)
            except OSError:
                _log(folder, manifest, "failed")
                raise
            _log(folder, manifest, "rolled-back-after-failure")
            raise e if isinstance(e, ApplyError) else ApplyError("write", str(e)) from e
    return name


def rollback(root: str, name: str) -> str:
    """Brings the source back and removes the target, unless either has changed since. Doing it twice is no error; returns the status."""
    base = Path(root).resolve()
    with lock(base):
        folder = base / STATE / "operations" / name
        if Path(name).name != name or not (folder / "manifest.json").is_file():
            raise ApplyError("missing", f"no such operation: {name}")
        manifest = json.loads((folder / "manifest.json").read_text())
        if manifest["status"].startswith("rolled-back"):
            return manifest["status"]
        at_source, at_target = inside(base, manifest["source"]), inside(base, manifest["target"])
        backup = (folder / "source.backup").read_bytes()
        if sha(backup) != manifest["source_before"]:
            raise ApplyError("conflict", "the backup has changed")
        if diagnosis(base, manifest) != "complete-writes":
            raise ApplyError("conflict", "the files have changed since")
        _replace(at_source, backup)
        at_target.unlink()
        _log(folder, manifest, "rolled-back")
        return "rolled-back"


def diagnosis(root: Path, manifest: dict) -> str:
    """What is on disk of an operation: source-and-target-missing, no-writes, complete-writes or partial-writes."""
    held = {k: sha(p.read_bytes()) if (p := inside(root, manifest[k])).is_file() else None for k in ("source", "target")}
    if held == {"source": None, "target": None}:
        return "source-and-target-missing"
    if held == {"source": manifest["source_before"], "target": None}:
        return "no-writes"
    return "complete-writes" if held == {"source": manifest["source_after"], "target": manifest["target_after"]} else "partial-writes"


def history(root: str) -> list[dict]:
    """The manifests, newest first; those that cannot be read have the status corrupted."""
    rows = []
    for folder in (Path(root).resolve() / STATE / "operations").glob("*"):
        try:
            manifest = json.loads((folder / "manifest.json").read_text())
            rows.append({k: manifest[k] for k in ("id", "created_at", "status", "source", "target")})
        except (OSError, ValueError, KeyError, TypeError):
            rows.append({"id": folder.name, "created_at": "", "status": "corrupted", "source": None, "target": None})
    return sorted(rows, key=lambda r: (r["created_at"], r["id"]), reverse=True)
