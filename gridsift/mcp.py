"""The tools over JSON-RPC lines on standard input and output, for assistants that speak the Model Context Protocol."""

from __future__ import annotations

import inspect
import json
import typing
from collections.abc import Iterable, Iterator
from typing import Any

from .tools import VERBS, Tools

# The protocol's version and error numbers.
VERSION = "2024-11-05"
PARSE_ERROR, NO_METHOD, BAD_PARAMS = -32700, -32601, -32602
_JSON = {str: "string", int: "integer", bool: "boolean", float: "number", list: "array", dict: "object"}


def described(name: str) -> dict[str, Any]:
    """A tool's name, what it takes and which of that it needs, from its signature."""
    method = getattr(Tools, name)
    hints, properties, needed = typing.get_type_hints(method), {}, []
    for p in list(inspect.signature(method).parameters.values())[1:]:
        kinds = [k for k in (typing.get_args(hints[p.name]) or (hints[p.name],)) if k is not type(None)] if not typing.get_origin(hints[p.name]) in (list, dict) else [hints[p.name]]
        properties[p.name] = {"type": _JSON[typing.get_origin(kinds[0]) or kinds[0]]}
        if p.default is p.empty:
            needed.append(p.name)
    return {"name": name, "description": (inspect.getdoc(method) or name.replace("_", " ")), "inputSchema": {"type": "object", "properties": properties, "required": needed}}


def answer(tools: Tools, message: dict[str, Any]) -> dict[str, Any] | None:
    """The response to one message; none to a notification. What a tool refuses is a result with isError, so that the caller can mend it."""
    if "id" not in message:
        return None
    out: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return out | {"result": {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "gridsift", "version": "1"}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        return out | {"result": {"tools": [described(n) for n in VERBS]}}
    if method == "tools/call":
        if params.get("name") not in VERBS:
            return out | {"error": {"code": BAD_PARAMS, "message": f"no tool {params.get('name')!r}"}}
        try:
            text, failed = json.dumps(tools.call(params["name"], params.get("arguments") or {}), ensure_ascii=False, default=str), False
        except (ValueError, TypeError, KeyError) as e:
            text, failed = str(e), True
        return out | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return out | {"error": {"code": NO_METHOD, "message": f"no method {method!r}"}}


def serve(tools: Tools, lines: Iterable[str]) -> Iterator[str]:
    """A line for each message that wants a response. Lines that are no JSON are told so."""
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except json.JSONDecodeError as e:
            yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(e)}})
            continue
        if (got := answer(tools, message)) is not None:
            yield json.dumps(got, ensure_ascii=False)
