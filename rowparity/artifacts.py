"""Publishing folders of results whole or not at all, on the driver's file system."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

MARK = "manifest.json"


def safe_slug(text: str) -> str:
    """Lower-case words joined by dashes; something in any case."""
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-") or "item"


def slugs(names: list[str]) -> dict[str, str]:
    """A slug for each name; equal ones get -a, -b and so on."""
    found: dict[str, str] = {}
    for name in names:
        base = slug = safe_slug(name)
        k = 0
        while slug in found.values():
            k += 1
            slug = f"{base}-{chr(96 + k) if k < 27 else k}"
        found[name] = slug
    return found


@contextlib.contextmanager
def workspace(target: str, force: bool = False) -> Iterator[Path]:
    """A private folder that becomes ``target`` if the block ends well.

    An existing target is replaced only with ``force``, and only if this
    module made it; the root and the home folder never are.
    """
    place = Path(target).resolve()
    if place in (Path("/"), Path.home().resolve()) or not place.parent.is_dir():
        raise ValueError(f"can't write results to {place}")
    if place.exists():
        if not force:
            raise FileExistsError(f"{place} exists")
        if not (place / MARK).is_file():
            raise ValueError(f"{place} isn't a folder of results")
    private = Path(tempfile.mkdtemp(prefix=f".{place.name}-", dir=place.parent))
    try:
        yield private
        if not (private / MARK).exists():
            write_manifest(private, {})
        old = private.with_name(private.name + "-old")
        if place.exists():
            os.replace(place, old)
        os.replace(private, place)
        shutil.rmtree(old, ignore_errors=True)
    finally:
        shutil.rmtree(private, ignore_errors=True)


def write_manifest(folder: Path, values: dict) -> None:
    """The folder's manifest: the values, and the checksum of each file in it."""
    files = {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(folder.rglob("*")) if p.is_file() and p.name != MARK}
    (folder / MARK).write_text(json.dumps(values | {"files": files}, indent=2, sort_keys=True))


def write_text(path: str, text: str, force: bool = False) -> None:
    """Writes a file whole or not at all; replaces one only with ``force``."""
    place = Path(path)
    if place.exists() and not force:
        raise FileExistsError(f"{place} exists")
    handle, name = tempfile.mkstemp(dir=place.parent, prefix=f".{place.name}-")
    try:
        with os.fdopen(handle, "w") as out:
            out.write(text)
        os.replace(name, place)
    finally:
        Path(name).unlink(missing_ok=True)


def checksum(path: str, block: int = 1 << 20) -> str:
    """The SHA-256 of a file, or of the names and files of a folder."""
    digest, root = hashlib.sha256(), Path(path)
    for p in sorted(root.rglob("*")) if root.is_dir() else [root]:
        if p.is_file():
            digest.update(str(p.relative_to(root)).encode() if p != root else b"")
            with p.open("rb") as source:
                while data := source.read(block):
                    digest.update(data)
    return digest.hexdigest()


def reproducibility(result: dict, arguments: list[str], inputs: list[str], reference: str | None, seconds: float) -> str:
    """What another run needs to be the same: the command, the checksums and the result."""
    named = lambda p: {"path": str(Path(p).resolve()), "sha256": checksum(p)}
    values = {"format": 1, "generated_utc": datetime.now(timezone.utc).isoformat(), "command": ["rowparity", *arguments], "duration_seconds": round(seconds, 6)}
    return json.dumps(values | {"inputs": [named(p) for p in inputs], "reference": named(reference) if reference else None, "comparison": result}, indent=2, sort_keys=True)
