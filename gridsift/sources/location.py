"""What an input names: a local path, a share link, or another address (which is not read)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urlsplit

# A host whose share links are known, and where their id stands.
SHARE_HOSTS = ("kdocs.cn",)
SHARE_PREFIX = "/l/"


@dataclass(frozen=True)
class Location:
    """kind: "local", "share" (with share_id) or "remote"."""

    kind: str
    text: str
    share_id: str | None = None


def locate(text: str, hosts: tuple[str, ...] = SHARE_HOSTS) -> Location:
    """hosts stand for their subdomains too. Downloading is the caller's business."""
    if not re.match(r"(?i)https?://", text):
        return Location("local", text)
    parts = urlsplit(text)
    host = (parts.hostname or "").lower()
    if any(host == h.lower() or host.endswith("." + h.lower()) for h in hosts):
        m = re.search(re.escape(SHARE_PREFIX) + r"([A-Za-z0-9_-]+)(?:/|$)", parts.path)
        if m:
            return Location("share", text, m[1])
    return Location("remote", text)
