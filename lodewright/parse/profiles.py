"""What is extracted from files per language: keys of their metadata and the patterns of their values.

Key names are fixed values. Patterns are built by rule: a keyword and the name that follows it, at the begin of a line or anywhere.
"""

from __future__ import annotations

NAME = r"([A-Za-z_]\w*)"


def after(*words: str, name: str = NAME, at_line: bool = False, before: str = "") -> str:
    """The name after one of some keywords; at_line: the keyword begins its line, but for words of the pattern before."""
    head = rf"(?m)^\s*{before}" if at_line else r"\b"
    return rf"{head}(?:{'|'.join(words)})\s+{name}"


def call(*words: str, value: str = r"""['"]([^'"\n]+)['"]""") -> str:
    """The first argument of a call, parentheses being optional."""
    return rf"\b(?:{'|'.join(words)})\s*\(?\s*{value}"


def attribute(name: str) -> str:
    return rf"""\b{name}\s*=\s*["']([^"'\n]+)["']"""


def block(word: str) -> str:
    """The first quoted label of a block at the begin of a line."""
    return rf'(?m)^\s*{word}\s+"([^"\n]+)"'


_ACCESS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|override|virtual|open|data|export|default|pub|unsafe|const|inline|indirect|suspend|case)\s+)*"
_JS, _JVM_TYPE = r"([A-Za-z_$][\w$]*)", r"(?m)^\s*" + _ACCESS


def _types(prefix: str, *kinds: tuple[str, str]) -> list[tuple[str, str]]:
    """(prefix_key, pattern) for key and keyword of each kind of type."""
    return [(f"{prefix}_{k}", rf"{_JVM_TYPE}{w}\s+{NAME}") for k, w in kinds]


_MEMBER = rf"(?m)^\s+(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|synchronized)\s+)+[\w<>\[\],.? ]+\s+{NAME}\s*\("
_C = [
    ("c_family_local_includes", r'(?m)^\s*#\s*include\s+"([^"\n]+)"'),
    ("c_family_system_includes", r"(?m)^\s*#\s*include\s+<([^>\n]+)>"),
    ("c_family_defines", r"(?m)^\s*#\s*define\s+(\w+)"),
    ("c_family_declared_functions", r"(?m)^[A-Za-z_][\w \t*]*?\b(\w+)\s*\([^;{)]*\)\s*[;{]"),
    ("c_family_types", r"\b(?:struct|union|enum)\s+(\w+)\s*\{"),
    ("c_family_has_inline_asm", r"\b(asm|__asm__|__asm)\b"),
]
_OBJC = [("objc_imports", r"""(?m)^\s*[#@]import\s+[<"]?([^>";\n]+)"""), ("objc_interfaces", r"@interface\s+(\w+)"), ("objc_implementations", r"@implementation\s+(\w+)"), ("objc_protocols", r"@protocol\s+(\w+)"), ("objc_methods", r"(?m)^\s*[-+]\s*\([^)]*\)\s*(\w+)")]
_SCRIPT = [
    ("js_imports", r"""\bfrom\s+['"]([^'"\n]+)['"]"""),
    ("js_exports", rf"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+{_JS}"),
    ("js_functions", rf"\bfunction\s*\*?\s*{_JS}"),
    ("js_classes", rf"\bclass\s+{_JS}"),
]
_HTML = [("html_root", r"(?i)<(html|body|template)\b"), ("html_elements", r"<([a-z][a-z0-9]*)\b"), ("html_custom_elements", r"<([a-z][a-z0-9]*-[a-z0-9-]+)"), ("html_attributes", r"\s([a-z][\w-]*)=[\"']"), ("html_links", attribute("(?:href|src)"))]
_CSS = [("css_imports", r"""@import\s+(?:url\()?['"]?([^'");\s]+)"""), ("css_selectors", r"(?m)^\s*([.#]?-?[A-Za-z_][\w-]*)[^{};\n]*\{"), ("css_variables", r"(--[\w-]+)\s*:")]
_COMPONENT = [("component_blocks", r"(?m)^<(script|style|template)\b"), ("component_script_languages", r"""<script[^>]*\blang=["'](\w+)["']"""), ("component_style_languages", r"""<style[^>]*\blang=["'](\w+)["']"""), ("component_imports", r"""\bimport\s+[^'"\n]*['"]([^'"\n]+)['"]""")]
_STARLARK = [("starlark_loads", r'\bload\(\s*"([^"\n]+)"'), ("starlark_loaded_symbols", r'\bload\(\s*"[^"\n]+"\s*,\s*"(\w+)"'), ("starlark_functions", after("def", at_line=True))]

PROFILES: dict[str, list[tuple[str, str]]] = {
    "go": [("go_package", after("package", at_line=True)), ("go_imports", r'(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$'), ("go_functions", rf"(?m)^func\s+{NAME}"), ("go_methods", rf"(?m)^func\s+\([^)]*\)\s*{NAME}"), ("go_receiver_types", r"(?m)^func\s+\(\s*(?:\w+\s+)?\*?(\w+)"), ("go_structs", rf"(?m)^type\s+{NAME}\s+struct\b"), ("go_interfaces", rf"(?m)^type\s+{NAME}\s+interface\b")],
    "python": [("python_imports", r"(?m)^\s*(?:import|from)\s+([\w.]+)"), ("python_classes", after("class", at_line=True)), ("python_functions", after("def", at_line=True, before=r"(?:async\s+)?")), ("python_decorators", r"(?m)^\s*@([\w.]+)"), ("python_has_async", r"\b(async)\s+(?:def|for|with)\b")],
    "javascript": _SCRIPT,
    "typescript": [*_SCRIPT, ("ts_interfaces", rf"\binterface\s+{_JS}"), ("ts_types", rf"\btype\s+{_JS}\s*(?:<[^>]*>)?\s*="), ("ts_enums", rf"\benum\s+{_JS}")],
    "c": _C,
    "objective_c": [*_C, *_OBJC],
    "rust": [("rust_modules", after("mod", at_line=True, before=r"(?:pub\s+)?")), ("rust_uses", after("use", name=r"([\w:]+)", at_line=True, before=r"(?:pub\s+)?")), ("rust_functions", after("fn")), ("rust_structs", after("struct")), ("rust_enums", after("enum")), ("rust_traits", after("trait")), ("rust_impls", rf"(?m)^\s*impl\b(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?{NAME}"), ("rust_uses_unsafe", r"\b(unsafe)\b")],
    "java": [("jvm_package", after("package", name=r"([\w.]+)", at_line=True)), ("jvm_imports", after("import", name=r"(?:static\s+)?([\w.*]+)", at_line=True)), *_types("java", ("classes", "class"), ("interfaces", "interface"), ("enums", "enum"), ("records", "record")), ("java_methods", _MEMBER), ("java_annotations", r"(?m)^\s*@(\w+)")],
    "kotlin": [("jvm_package", after("package", name=r"([\w.]+)", at_line=True)), ("jvm_imports", after("import", name=r"([\w.*]+)", at_line=True)), *_types("kotlin", ("classes", "class"), ("interfaces", "interface"), ("objects", "object"), ("functions", "fun")), ("kotlin_has_suspend", r"\b(suspend)\s+fun\b")],
    "csharp": [("csharp_usings", after("using", name=r"([\w.]+)\s*;", at_line=True)), ("csharp_namespaces", after("namespace", name=r"([\w.]+)")), *_types("csharp", ("classes", "class"), ("records", "record"), ("interfaces", "interface"), ("enums", "enum")), ("csharp_methods", _MEMBER), ("csharp_attributes", r"(?m)^\s*\[(\w+)"), ("csharp_has_async", r"\b(async)\s")],
    "ruby": [("ruby_requires", call("require", "require_relative")), ("ruby_modules", after("module", name=r"([\w:]+)", at_line=True)), ("ruby_classes", after("class", name=r"([\w:]+)", at_line=True)), ("ruby_methods", after("def", name=r"(\w+[?!=]?)", at_line=True)), ("ruby_singleton_methods", after("def", name=r"self\.(\w+[?!=]?)", at_line=True))],
    "php": [("php_namespaces", after("namespace", name=r"([\w\\]+)", at_line=True)), ("php_uses", after("use", name=r"([\w\\]+)", at_line=True)), *_types("php", ("classes", "class"), ("interfaces", "interface"), ("traits", "trait"), ("enums", "enum")), ("php_functions", after("function")), ("php_attributes", r"#\[\s*(\w+)")],
    "shell": [("shell_shebang", r"\A#!\s*(\S+)"), ("shell_functions", rf"(?m)^\s*(?:function\s+)?{NAME}\s*\(\)\s*\{{"), ("shell_service_functions", r"(?m)^\s*(start_service|stop_service|reload_service|service_started|service_stopped|service_triggers|boot|shutdown)\s*\(\)"), ("shell_sources", r"(?m)^\s*(?:\.|source)\s+(\S+)"), ("shell_exports", after("export", at_line=True)), ("shell_commands", r"(?m)^\s*([a-z][\w-]*)(?:\s|$)")],
    "swift": [("swift_imports", after("import", at_line=True)), *_types("swift", ("classes", "class"), ("structs", "struct"), ("enums", "enum"), ("protocols", "protocol"), ("actors", "actor"), ("extensions", "extension")), ("swift_functions", after("func")), ("swift_properties", after("var", "let")), ("swift_has_async", r"\b(async)\b")],
    "scala": [("scala_package", after("package", name=r"([\w.]+)", at_line=True)), ("scala_imports", after("import", name=r"([\w.{}]+)", at_line=True)), ("scala_classes", after("class")), ("scala_objects", after("object")), ("scala_traits", after("trait")), ("scala_enums", after("enum")), ("scala_defs", after("def")), ("scala_values", after("val", "var"))],
    "lua": [("lua_requires", call("require")), ("lua_modules", call("module")), ("lua_functions", after("function", name=r"([\w.:]+)")), ("lua_locals", after("local"))],
    "perl": [("perl_packages", after("package", name=r"([\w:]+)", at_line=True)), ("perl_modules", after("use", name=r"([A-Z][\w:]*)", at_line=True)), ("perl_requires", after("require", name=r"([\w:]+)", at_line=True)), ("perl_subroutines", after("sub", at_line=True)), ("perl_uses_strict", r"(?m)^\s*use\s+(strict)\b"), ("perl_uses_warnings", r"(?m)^\s*use\s+(warnings)\b")],
    "elixir": [("elixir_modules", after("defmodule", name=r"([\w.]+)")), *[(f"elixir_{k}", after(w, name=r"([A-Z][\w.]*)", at_line=True)) for k, w in (("aliases", "alias"), ("imports", "import"), ("requires", "require"), ("uses", "use"))], *[(f"elixir_{k}", after(w, name=r"(\w+[?!]?)", at_line=True)) for k, w in (("functions", "def"), ("private_functions", "defp"), ("macros", "defmacro"))]],
    "erlang": [("erlang_module", r"(?m)^-module\((\w+)\)"), ("erlang_exports", r"(\w+/\d+)"), ("erlang_records", r"(?m)^-record\((\w+)"), ("erlang_behaviours", r"(?m)^-behaviou?r\((\w+)"), ("erlang_functions", r"(?m)^([a-z]\w*)\(")],
    "zig": [("zig_imports", r'@import\("([^"\n]+)"\)'), ("zig_functions", after("fn")), *[(f"zig_{w}s", rf"\bconst\s+{NAME}\s*=\s*(?:packed\s+|extern\s+)?{w}\b") for w in ("struct", "enum", "union")], ("zig_tests", block("test"))],
    "powershell": [("powershell_functions", r"(?im)^\s*function\s+([\w-]+)"), ("powershell_parameters", r"(?i)\[\w+(?:\[\])?\]\s*\$(\w+)"), ("powershell_imported_modules", r"(?im)^\s*Import-Module\s+(\S+)"), ("powershell_cmdlets", r"\b([A-Z][a-z]+-[A-Z]\w+)\b")],
    "groovy": [("groovy_imports", after("import", name=r"(?:static\s+)?([\w.*]+)", at_line=True)), *_types("groovy", ("classes", "class"), ("interfaces", "interface"), ("traits", "trait"), ("enums", "enum")), ("groovy_methods", rf"(?m)^\s*(?:def|void|String|int|boolean)\s+{NAME}\s*\("), ("groovy_annotations", r"(?m)^\s*@(\w+)"), ("gradle_plugins", call("id")), ("gradle_dependencies", call("implementation", "api", "compileOnly", "runtimeOnly", "testImplementation")), ("gradle_tasks", after("task"))],
    "graphql": [("graphql_operations", after("query", "mutation", "subscription")), ("graphql_operation_kinds", r"(?m)^\s*(query|mutation|subscription)\b"), ("graphql_fragments", after("fragment")), ("graphql_fragment_types", r"\bfragment\s+\w+\s+on\s+(\w+)"), *[(f"graphql_{w}s", after(w, at_line=True)) for w in ("type", "input", "interface", "enum", "union", "scalar")]],
    "protobuf": [("proto_package", after("package", name=r"([\w.]+)", at_line=True)), ("proto_imports", r'(?m)^\s*import\s+(?:public\s+|weak\s+)?"([^"\n]+)"'), ("proto_messages", after("message")), ("proto_services", after("service")), ("proto_rpcs", after("rpc")), ("proto_enums", after("enum"))],
    "terraform": [("terraform_resources", block("resource")), ("terraform_data_sources", block("data")), ("terraform_modules", block("module")), ("terraform_variables", block("variable")), ("terraform_outputs", block("output")), ("terraform_providers", block("provider"))],
    "packer": [("packer_sources", block("source")), ("packer_blocks", r"(?m)^\s*(build|source|variable|locals|packer|data)\b"), ("packer_variables", block("variable"))],
    "dockerfile": [("docker_base_images", r"(?im)^\s*FROM\s+(\S+)"), ("docker_stages", r"(?im)^\s*FROM\s+\S+\s+AS\s+(\S+)"), ("docker_instructions", r"(?m)^\s*([A-Z]{3,})\s"), ("docker_exposed_ports", r"(?im)^\s*EXPOSE\s+(\S+)"), ("docker_copy_sources", r"(?im)^\s*(?:COPY|ADD)\s+(?:--\S+\s+)*(\S+)"), ("docker_entrypoints", r"(?im)^\s*(?:ENTRYPOINT|CMD)\s+([^\n]+)")],
    "cmake": [("cmake_commands", r"(?m)^\s*(\w+)\s*\("), ("cmake_projects", r"(?i)\bproject\s*\(\s*(\w+)"), ("cmake_targets", r"(?i)\badd_(?:executable|library)\s*\(\s*(\S+)"), ("cmake_packages", r"(?i)\bfind_package\s*\(\s*(\w+)")],
    "meson": [("meson_projects", call("project")), ("meson_targets", call("executable", "library", "shared_library", "static_library")), ("meson_dependencies", call("dependency"))],
    "starlark": _STARLARK,
    "bazel": [*_STARLARK, ("bazel_rules", r"(?m)^(\w+)\(\s*$"), ("bazel_targets", attribute("name")), ("bazel_has_package_declaration", r"(?m)^(package)\(")],
    "sql": [("sql_operations", r"(?im)^\s*(select|insert|update|delete|create|alter|drop|merge)\b"), ("sql_tables", r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)"), ("sql_indexes", r"(?i)\bcreate\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?(\w+)"), ("sql_functions", r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.]+)")],
    "xml": [("xml_root", r"\A(?:\s|<\?[^>]*\?>|<!--(?:[^-]|-[^-])*-->|<![^>]*>)*<([\w:.-]+)"), ("xml_elements", r"<([A-Za-z_][\w:.-]*)"), ("xml_attributes", r"\s([A-Za-z_][\w:.-]*)=[\"']")],
    "html": _HTML,
    "css": _CSS,
    "scss": [*_CSS, ("scss_mixins", r"@mixin\s+([\w-]+)"), ("scss_includes", r"@include\s+([\w.-]+)")],
    "vue": [*_COMPONENT, *_HTML],
    "svelte": [*_COMPONENT, *_HTML],
    "autotools": [("autotools_macros", r"\b(A[CM]_[A-Z_]+)\b"), ("autotools_definitions", r"\bA[CM]_DEFINE(?:_UNQUOTED)?\(\[?(\w+)")],
    "linker_script": [("linker_sections", r"(?m)^\s*(\.[\w.]+)\s*(?:\([^)]*\))?\s*:"), ("linker_provided_symbols", r"\bPROVIDE(?:_HIDDEN)?\s*\(\s*(\w+)"), ("linker_entry_symbols", r"\bENTRY\s*\(\s*(\w+)")],
    "boot_script": [("boot_script_commands", r"(?m)^\s*([a-z]\w*)(?:\s|$)"), ("boot_script_variables", after("setenv", at_line=True))],
    "awk": [("awk_functions", after("function"))],
    "lex": [("lex_start_conditions", r"(?m)^%[xs]\s+(\w+)")],
    "yacc": [("yacc_tokens", r"(?m)^%token\s+(?:<\w+>\s+)?(\w+)"), ("yacc_rules", r"(?m)^(\w+)\s*:")],
    "doc": [("doc_headings", r"(?m)^#{1,6} +([^\n]+?) *$"), ("doc_links", r"\]\(([^)\s]+)\)"), ("doc_fenced_languages", r"(?m)^```(\w+)")],
}
PROFILES["objective_cpp"] = PROFILES["objective_c"]
#: Keys of a language's files that do not go on to its records; of Go's the package does (fixed value).
FILE_ONLY = sorted({k for pairs in PROFILES.values() for k, _ in pairs} - {"go_package"})


def module_name(path: str) -> str:
    """SQL for python_module: the dotted path of a module, a package by its folder, src/ left out."""
    return f"regexp_replace(regexp_replace(regexp_replace({path}, '^(?:[^/]*/)?src/|^[^/]*/', ''), '(?:/__init__)?[.]py$', ''), '/', '.')"
