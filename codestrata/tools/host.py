"""The agent loop, and the same tools for an MCP server."""

from __future__ import annotations

from codestrata.tools.registry import TOOLS, Context, run_tool

MAX_STEPS = 12
SYSTEM = "You answer questions about a C++ code base with the tools given. Cite file:line evidence."


class Host:
    def __init__(self, context: Context, client):
        self.context, self.client, self.history = context, client, []

    def ask(self, question: str) -> str:
        """The answer; at most MAX_STEPS turns with tools, one call after another."""
        self.history.append({"role": "user", "content": question})
        for _ in range(MAX_STEPS):
            reply = self.client.generate_with_tools(self.history, [t.schema() for t in TOOLS.values()], SYSTEM)
            self.history.append(reply.message or {"role": "assistant", "content": reply.text})
            if not reply.calls:
                return reply.text
            for call in reply.calls:
                self.history.append(self.client.tool_result(call, run_tool(self.context, call.name, call.args)))
        return f"No answer within {MAX_STEPS} steps."


def mcp_server(context: Context):
    """A server that offers the registry, if the package `mcp` is installed."""
    from mcp.server import Server  # noqa: PLC0415  optional
    from mcp.types import TextContent
    from mcp.types import Tool as McpTool

    server = Server("codestrata")

    @server.list_tools()
    async def list_tools():
        return [McpTool(name=t.name, description=t.description, inputSchema=t.parameters) for t in TOOLS.values()]

    @server.call_tool()
    async def call_tool(name: str, arguments: dict):
        return [TextContent(type="text", text=run_tool(context, name, arguments))]

    return server
