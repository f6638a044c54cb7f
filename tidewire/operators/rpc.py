"""The read tools over JSON-RPC: one message in, one reply out, without any state between them."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame

from tidewire.operators import serve

# Protocol revisions, newest first, and the names of metadata fields, headers and error codes.
MODERN = ("2026-07-28",)
LEGACY = ("2025-11-25", "2025-06-18", "2025-03-26")
META = "io.modelcontextprotocol/"
MIRRORED = {"tools/call": "name", "resources/read": "uri", "prompts/get": "name"}
PARSE, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, INTERNAL, HEADER_MISMATCH, NO_VERSION = -32700, -32600, -32601, -32602, -32603, -32020, -32022
MOST_BYTES, LIST_SECONDS = 64 * 1024, 3600


@dataclass(frozen=True)
class Server:
    """What a server tells of itself, and whom it serves; `origins` may hold "*"."""

    name: str = "news-briefings"
    title: str = "News briefings"
    version: str = "1.0.0"
    instructions: str = "Daily news briefings, one a day (UTC). get_daily_news lists a day's stories, get_topic gives one in full."
    origins: tuple[str, ...] = ()
    allow: Callable[[Mapping[str, str]], bool] | None = None
    observe: Callable[[dict], None] | None = None

    @property
    def info(self) -> dict:
        return {"name": self.name, "title": self.title, "version": self.version}


@dataclass
class Reply:
    status: int
    body: dict | None = None
    headers: dict[str, str] = field(default_factory=dict)


class RpcError(Exception):
    def __init__(self, status: int, code: int, message: str, data: dict | None = None):
        super().__init__(message)
        self.status, self.code, self.data = status, code, data


TOOLS = (
    {"name": "get_daily_news", "description": "A day's stories and overview.", "inputSchema": {"type": "object", "properties": {"date": {"type": "string"}}}},
    {"name": "get_topic", "description": "One story of a day in full.", "inputSchema": {"type": "object", "properties": {"date": {"type": "string"}, "topic_id": {"type": "string"}}, "required": ["date", "topic_id"]}},
)


def header_value(value: str) -> str | None:
    """A header's text; =?base64?...?= is decoded, and None where it does not hold UTF-8."""
    if not (value.startswith("=?base64?") and value.endswith("?=")):
        return value
    try:
        return base64.b64decode(value[9:-2], validate=True).decode()
    except (binascii.Error, UnicodeDecodeError):
        return None


def _unsupported(asked: object) -> RpcError:
    return RpcError(400, NO_VERSION, "Unsupported protocol version", {"supported": [*MODERN, *LEGACY], "requested": asked})


def version_of(message: dict, headers: Mapping[str, str]) -> str:
    """The revision a request is served under; a modern one must repeat method, name and revision in its headers."""
    params = message.get("params")
    meta = params.get("_meta") if isinstance(params, dict) else None
    told = meta.get(META + "protocolVersion") if isinstance(meta, dict) else None
    header = headers.get("mcp-protocol-version")
    if told is None:
        if header in MODERN:
            raise RpcError(400, INVALID_PARAMS, f"Missing required _meta field {META}protocolVersion")
        if header and header not in LEGACY:
            raise _unsupported(header)
        return header or LEGACY[-1]
    if header != told:
        raise RpcError(400, HEADER_MISMATCH, f"Header mismatch: MCP-Protocol-Version {header!r} against {told!r} in the body")
    if told not in MODERN:
        raise _unsupported(told)
    if not isinstance(meta.get(META + "clientCapabilities"), dict | list):
        raise RpcError(400, INVALID_PARAMS, f"Missing required _meta field {META}clientCapabilities")
    if headers.get("mcp-method") != message["method"]:
        raise RpcError(400, HEADER_MISMATCH, "Header mismatch: Mcp-Method must repeat the method")
    mirrored = MIRRORED.get(message["method"])
    if mirrored and (headers.get("mcp-name") is None or header_value(headers["mcp-name"]) != params.get(mirrored)):
        raise RpcError(400, HEADER_MISMATCH, f"Header mismatch: Mcp-Name must repeat {mirrored}")
    return told


def _result(message: dict, modern: bool, server: Server, days: DataFrame, today: date) -> dict:
    method, params = message["method"], message.get("params") or {}
    listed = {"ttlMs": LIST_SECONDS * 1000, "cacheScope": "public"}
    if method == "ping":
        return {}
    if method == "server/discover" and modern:
        return {"supportedVersions": [*MODERN, *LEGACY], "capabilities": {"tools": {}}, "instructions": server.instructions} | listed
    if method == "tools/list":
        return {"tools": list(TOOLS)} | (listed if modern else {})
    if method != "tools/call":
        raise RpcError(404, NO_METHOD, f"Method not found: {method}")
    name, arguments = params.get("name"), params.get("arguments", {})
    if not isinstance(name, str) or name not in serve.TOOLS:
        raise RpcError(200, INVALID_PARAMS, f"Unknown tool: {name}" if isinstance(name, str) else "params.name must be a string")
    if not isinstance(arguments, dict):
        raise RpcError(200, INVALID_PARAMS, "params.arguments must be an object")
    return serve.call_tool(name, arguments, days, today)


def _failure(id_: object, error: RpcError) -> Reply:
    told = {"code": error.code, "message": str(error)} | ({"data": error.data} if error.data is not None else {})
    return Reply(error.status, {"jsonrpc": "2.0"} | ({"id": id_} if id_ is not None else {}) | {"error": told})


def post(body: bytes, headers: Mapping[str, str], server: Server, days: DataFrame, today: date) -> Reply:
    """The reply to one posted message; header names are in lower case. A notification is taken without an answer."""
    if len(body) > MOST_BYTES:
        return _failure(None, RpcError(413, INVALID_REQUEST, "Request body too large"))
    try:
        message = json.loads(body)
    except ValueError:
        return _failure(None, RpcError(400, PARSE, "Parse error"))
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
        return _failure(message.get("id") if isinstance(message, dict) else None, RpcError(400, INVALID_REQUEST, "Body must be a single JSON-RPC 2.0 request or notification"))
    if "id" not in message:
        return Reply(202)
    id_ = message["id"]
    if isinstance(id_, bool) or not isinstance(id_, str | int | float):
        return _failure(None, RpcError(400, INVALID_REQUEST, "Request id must be a string or integer"))
    modern = False
    try:
        if message["method"] == "initialize":
            asked = (message.get("params") or {}).get("protocolVersion")
            result = {"protocolVersion": asked if asked in LEGACY else LEGACY[0], "capabilities": {"tools": {}}, "serverInfo": server.info, "instructions": server.instructions}
        else:
            modern = version_of(message, headers) in MODERN
            if server.allow is not None and message["method"] == "tools/call" and not server.allow(headers):
                raise RpcError(429, INTERNAL, "Rate limit exceeded, retry in a minute")
            result = _result(message, modern, server, days, today)
            if modern:
                result = {"resultType": "complete"} | result | {"_meta": {META + "serverInfo": server.info}}
        cached = modern and message["method"] in ("server/discover", "tools/list")
        reply = Reply(200, {"jsonrpc": "2.0", "id": id_, "result": result}, {"Cache-Control": f"public, max-age={LIST_SECONDS}"} if cached else {})
    except RpcError as e:
        reply = _failure(id_, e)
    except Exception:  # noqa: BLE001  a caller learns no more than that it failed
        reply = _failure(id_, RpcError(500, INTERNAL, "Internal error"))
    if server.observe is not None:
        server.observe({"method": message["method"], "era": "modern" if modern else "legacy", "status": reply.status, "error": (reply.body or {}).get("error", {}).get("code")})
    return reply


def server_card(server: Server, endpoint: str) -> dict:
    return server.info | {
        "description": server.instructions, "supportedProtocolVersions": [*MODERN, *LEGACY], "remotes": [{"type": "streamable-http", "url": endpoint}],
        "capabilities": {"tools": {}}, "authentication": {"required": False},
    }


def handle(verb: str, origin_of_url: str, path: str, body: bytes, headers: Mapping[str, str], server: Server, days: DataFrame, today: date) -> Reply:
    """One HTTP request: the server's card, its greeting, or the message endpoint at /mcp for allowed origins."""
    if verb == "GET" and path == "/.well-known/mcp/server-card.json":
        return Reply(200, server_card(server, f"{origin_of_url}/mcp"), {"Cache-Control": "public, max-age=3600", "Access-Control-Allow-Origin": "*"})
    if verb == "GET" and path == "/":
        return Reply(200, server.info | {"mcp_endpoint": f"{origin_of_url}/mcp", "transport": "streamable-http", "protocol_versions": [*MODERN, *LEGACY]})
    if path != "/mcp":
        return Reply(404, {"error": "Not found"})
    origin = headers.get("origin")
    if origin and "*" not in server.origins and origin not in server.origins:
        return _failure(None, RpcError(403, INVALID_REQUEST, "Forbidden origin"))
    if verb == "POST":
        reply = post(body, headers, server, days, today)
    else:
        reply = Reply(204) if verb == "OPTIONS" else Reply(405, None, {"Allow": "POST, OPTIONS"})
    if origin:
        reply.headers |= {"Access-Control-Allow-Origin": origin, "Access-Control-Allow-Methods": "POST, OPTIONS", "Access-Control-Max-Age": "86400", "Vary": "Origin"}
        reply.headers["Access-Control-Allow-Headers"] = "Content-Type, Accept, Authorization, MCP-Protocol-Version, Mcp-Method, Mcp-Name, Mcp-Session-Id, Last-Event-ID"
    return reply
