"""Files from elsewhere, on the driver: downloads, members of archives, bundles, and where artifacts are looked for."""

from __future__ import annotations

import os
import tarfile
import urllib.request
import zipfile
from collections.abc import Mapping

STEP = 1 << 20


def download(url: str, path: str, timeout: float = 60.0) -> str | None:
    """Fetch ``url`` to ``path`` unless it is there. It grows under another name and is renamed when whole, so a broken
    download is never taken for a finished one. Returns the time the server gave, which is also kept beside the file."""
    note = path + ".snapshot"
    if not os.path.exists(path):
        with urllib.request.urlopen(url, timeout=timeout) as source, open(path + ".part", "wb") as out:
            while step := source.read(STEP):
                out.write(step)
            stamp = source.headers.get("Last-Modified") or ""
        with open(note, "w", encoding="utf-8") as f:
            f.write(stamp)
        os.replace(path + ".part", path)
    if not os.path.exists(note):
        return None
    with open(note, encoding="utf-8") as f:
        return f.read() or None


def extract(archive: str, member: str, path: str) -> None:
    """One member of a zip file; the error for an unknown one lists what there is."""
    with zipfile.ZipFile(archive) as z:
        found = [n for n in z.namelist() if n == member or n.rsplit("/", 1)[-1] == member]
        if not found:
            raise FileNotFoundError(f"no {member} in {archive}; it holds {', '.join(sorted(z.namelist()))}")
        with z.open(found[0]) as source, open(path + ".part", "wb") as out:
            while step := source.read(STEP):
                out.write(step)
    os.replace(path + ".part", path)


def fetch_bundle(url: str, folder: str, sentinel: str) -> bool:
    """Unpack a tar bundle into ``folder`` unless its file ``sentinel`` is there; members that point outside are refused."""
    if os.path.exists(os.path.join(folder, sentinel)):
        return False
    os.makedirs(folder, exist_ok=True)
    packed = os.path.join(folder, ".bundle")
    download(url, packed)
    with tarfile.open(packed) as t:
        t.extractall(folder, filter="data")
    os.remove(packed)
    if not os.path.exists(os.path.join(folder, sentinel)):
        raise FileNotFoundError(f"the bundle holds no {sentinel}")
    return True


def resolve(name: str, folders: list[str], variable: str | None = None, env: Mapping[str, str] = os.environ) -> str:
    """The first folder that holds ``name``, that of the environment variable first; the error names all that were tried."""
    tried = [os.path.join(f, name) for f in ([env[variable]] if variable and env.get(variable) else []) + folders]
    for path in tried:
        if os.path.exists(path):
            return path
    raise FileNotFoundError(f"{name} is at none of {', '.join(tried)}")
