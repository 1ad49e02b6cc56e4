"""AI tools, servers and model files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in the order in which they are tried.
TOOLS = [
    ("cursor", "cursor"), ("claude-code", "claude"), ("aider", "aider"), ("ollama", "ollama"), ("github-copilot", "github-copilot-language-server"),
    ("copilot", "copilot"), ("cody", "cody"), ("codeium", "codeium"), ("codeium", "codeium_language_server"), ("tabnine", "tabnine"),
    ("windsurf", "windsurf"), ("cline", "cline"), ("shell-gpt", "sgpt"), ("chatgpt", "chatgpt"), ("codex", "codex"), ("gemini", "gemini"),
    ("aichat", "aichat"), ("llm", "llm"), ("zed", "zed"),
]
INTERPRETERS = ["node", "python", "python3", "python2", "deno", "bun", "ruby", "npx", "uv", "uvx", "pipx", "pnpm", "yarn"]
RUNTIMES = [
    ("ollama", "Ollama"), ("lm-studio", "LM Studio"), ("lmstudio", "LM Studio"), ("llama-server", "llama.cpp"), ("llama.cpp", "llama.cpp"),
    ("llamacpp", "llama.cpp"), ("vllm", "vLLM"), ("text-generation", "Text Generation WebUI"), ("localai", "LocalAI"), ("local-ai", "LocalAI"),
    ("koboldcpp", "KoboldCpp"), ("kobold", "KoboldCpp"), ("gpt4all", "GPT4All"), ("tabby", "Tabby"), ("open-webui", "Open WebUI"),
    ("openwebui", "Open WebUI"), ("llamafile", "llamafile"), ("litellm", "LiteLLM"), ("sglang", "SGLang"), ("ramalama", "RamaLama"), ("jan", "Jan"),
]
RUNTIME_PORTS = {11434: "Ollama", 1234: "LM Studio", 1337: "Jan"}
FORMATS = {
    "gguf": ("gguf", False), "ggml": ("ggml", False), "safetensors": ("safetensors", False), "onnx": ("onnx", False), "h5": ("keras-h5", False),
    "hdf5": ("keras-h5", False), "npz": ("numpy-npz", False), "pt": ("pytorch", True), "pth": ("pytorch", True), "bin": ("pytorch-bin", True),
    "ckpt": ("checkpoint", True), "pkl": ("pickle", True), "pickle": ("pickle", True),
}
#: Kernels cut a process name here, so a name of this length stands for a longer one.
COMM = 15


def tool_basename(image: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(image, r"([^\\/]*)\z", 1)), r"(?<=.)\.(py|js|mjs|cjs|exe)\z", "")


def _catalog() -> dict[str, str]:
    """Tools by name, and by the cut-off form of longer names; of equal ones the catalog's first."""
    out: dict[str, str] = {}
    for tool, name in TOOLS:
        for key in (name, name[:COMM]) if len(name) > COMM else (name,):
            out.setdefault(key, tool)
    return out


def tool_of(image: Column) -> Column:
    """The catalog's first tool of that name, or of which the name is a cut-off form; null for none. The name is worked out
    once, and looked up."""
    names = F.create_map(*[F.lit(x) for pair in _catalog().items() for x in pair])
    return F.try_element_at(names, tool_basename(image))


def tool_in_cmdline(cmdline: Column) -> Column:
    """The first word that isn't an option and names a tool."""
    words = F.filter(F.split(F.trim(cmdline), r"\s+"), lambda w: ~w.startswith("-"))
    return F.get(F.filter(F.transform(words, tool_of), lambda t: t.isNotNull()), 0)


def is_interpreter(image: Column) -> Column:
    base = tool_basename(image)
    return F.coalesce(base.isin(INTERPRETERS) | base.rlike(r"\Apython[0-9.]*\z"), F.lit(False))


def runtime_of(process: Column, port: Column) -> Column:
    low = F.lower(process)
    tries = [F.when(low.contains(n), name) for n, name in RUNTIMES] + [F.when(port == p, name) for p, name in RUNTIME_PORTS.items()]
    return F.coalesce(*tries)


def is_exposed(addr: Column) -> Column:
    a = F.trim(addr)
    return ~(a.startswith("127.") | (a == "::1") | (F.lower(a) == "localhost"))


def model_format(path: Column) -> Column:
    """(format, risky) by extension; null for what is no model file. Risky ones can run code when they are loaded."""
    ext = F.lower(F.substring_index(path, ".", -1))
    out = F.lit(None)
    for e, (fmt, risky) in FORMATS.items():
        out = F.when(ext == e, F.struct(F.lit(fmt).alias("format"), F.lit(risky).alias("risky"))).otherwise(out)
    return out
