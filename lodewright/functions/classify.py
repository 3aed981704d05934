"""Language, flags, class and role of a file from its path and text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: languages by suffix
SUFFIXES = {
    "rust": ".rs", "go": ".go", "python": ".py", "java": ".java", "kotlin": ".kt .kts", "csharp": ".cs", "swift": ".swift",
    "objective_c": ".m", "objective_cpp": ".mm", "javascript": ".js .jsx", "typescript": ".ts .tsx", "html": ".html .htm",
    "css": ".css", "scss": ".scss .sass", "vue": ".vue", "svelte": ".svelte", "graphql": ".graphql .gql", "starlark": ".bzl .star",
    "groovy": ".groovy .gradle", "powershell": ".ps1 .psm1 .psd1", "scala": ".scala .sbt", "elixir": ".ex .exs", "erlang": ".erl .hrl",
    "zig": ".zig", "php": ".php", "ruby": ".rb", "xml": ".xml", "sql": ".sql", "protobuf": ".proto", "terraform": ".tf .tfvars .hcl",
    "cmake": ".cmake", "perl": ".pl .pm", "awk": ".awk", "lex": ".l", "yacc": ".y", "make": ".mk", "kconfig": ".in", "dts": ".dts .dtsi .dtso",
    "patch": ".patch .diff", "json": ".json", "toml": ".toml", "yaml": ".yaml .yml", "lua": ".lua", "ucode": ".uc", "doc": ".md .rst",
    "autotools": ".m4 .am .ac", "shell": ".common .failsafe .hotplug .initd .local .script .usb .usbmisc .user .sh",
    "linker_script": ".ld .lds", "boot_script": ".bootscript .scr",
    "config": ".cfg .cnf .conf .config .default .defaults .init .seed .service",
}
C_SUFFIXES = ".c .h .cc .cpp .cxx .hh .hpp .hxx".split()  # fixed values
SOURCE = "asm bazel c csharp css elixir erlang graphql go groovy html java javascript kotlin lua php perl objective_c objective_cpp powershell protobuf python ruby rust scala scss sql shell starlark svelte swift terraform typescript ucode vue zig dts awk lex linker_script yacc".split()  # fixed values
BUILD_LANGUAGES = "autotools bazel boot_script cmake dockerfile linker_script make meson packer starlark".split()  # fixed values
CONFIG_LANGUAGES = "css graphql kconfig config json packer scss sql terraform toml xml yaml".split()  # fixed values
BUILD_NAMES = ".bazelrc cargo.toml build.gradle build.gradle.kts go.mod go.sum jenkinsfile pyproject.toml setup.py settings.gradle settings.gradle.kts build.sbt package.json tsconfig.json".split()  # fixed values
TEST_PARTS, VENDOR_PARTS, DOC_ROOTS = ["test", "tests", "testing", "selftests"], ["vendor", "third_party", "3rdparty"], ["docs", "doc", "Documentation"]  # fixed values
GENERATED_HEADER = r"(?im)^(?://|#|/\*)\s*Code generated\b.*\bDO NOT EDIT\.?"  # fixed value
FLAG_CLASSES = (("is_doc", "doc"), ("is_build", "build"), ("is_config", "config"), ("is_test", "test"), ("is_vendor", "vendor"), ("is_generated", "generated"), ("is_source", "source"))  # fixed values


def base_name(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path) -> Column:
    """The last dotted part with its dot; empty for dotfiles and names without a dot."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def language(path) -> Column:
    """Language by special names and suffixes; text if nothing fits."""
    name, low, end = base_name(path), F.lower(base_name(path)), F.lower(suffix(path))
    known = F.create_map(*[F.lit(x) for lang, ends in SUFFIXES.items() for e in ends.split() for x in (e, lang)])
    by_suffix = F.coalesce(F.try_element_at(known, end), F.lit("text"))
    docker = name.isin("Dockerfile", "Containerfile") | low.endswith(".dockerfile") | low.rlike(r"^(?:dockerfile|containerfile)[.-]")
    return (
        F.when(end.isin(*C_SUFFIXES), "c")
        .when(suffix(path).isin(".s", ".S"), "asm")
        .when(name == "Makefile", "make")
        .when(name.isin("Kconfig", "Config.in", "Config-defaults.in"), "kconfig")
        .when(docker, "dockerfile")
        .when(name == "CMakeLists.txt", "cmake")
        .when(name.isin("meson.build", "meson_options.txt"), "meson")
        .when(name.isin("BUILD", "BUILD.bazel", "WORKSPACE", "WORKSPACE.bazel", "MODULE.bazel") | (low == ".bazelrc"), "bazel")
        .when(name == "Jenkinsfile", "groovy")
        .when(F.lower(path).rlike(r"\.(?:pkr|pkrvars)\.hcl$"), "packer")
        .when(F.contains(path, F.lit("/init.d/")) | F.contains(path, F.lit("/preinit/")), "shell")
        .when(name.isin("config", "inittab") | name.startswith("Config.") | name.rlike(r"^config-\d+(?:\.\d+)*$"), "config")
        .otherwise(by_suffix)
    )


def refined_language(path, content) -> Column:
    """language, with headers of Objective-C and shebangs of unnamed scripts told by the text."""
    by_path, head = language(path), F.substring(content, 1, 8192)
    first = F.lower(F.trim(F.regexp_extract(content, r"^([^\n]*)", 1)))
    bang = (
        F.when(F.contains(first, F.lit("perl")), "perl")
        .when(first.rlike("pwsh|powershell"), "powershell")
        .when(F.contains(first, F.lit("ucode")), "ucode")
        .when(F.contains(first, F.lit("ash")) | first.rlike(r"(?:^|/|\s)sh(?:\s|$)"), "shell")
    )
    text = F.when(F.lower(content).startswith("# syntax=docker/dockerfile"), "dockerfile").when(first.startswith("#!"), F.coalesce(bang, F.lit("text"))).otherwise("text")
    objective = (by_path == "c") & F.lower(path).endswith(".h") & head.rlike("@interface|@protocol|@implementation|#import")
    return F.when(content.isNull(), by_path).when(objective, "objective_c").when(by_path == "text", text).otherwise(by_path)


def flags(path, lang, content=None) -> dict[str, Column]:
    """The seven flags."""
    parts, name, low = F.split(path, "/"), base_name(path), F.lower(base_name(path))
    lows = F.transform(parts, lambda p: F.lower(p))
    any_of = lambda arr, vals: F.arrays_overlap(arr, F.array(*[F.lit(v) for v in vals]))
    generated = any_of(lows, ["generated", "autogenerated"]) | F.contains(low, F.lit("generated"))
    generated = generated | (lang == "go") & any_of(lows, ["applyconfiguration", "clientset", "informers", "listers"]) & any_of(lows, ["client", "pkg"])
    if content is not None:
        generated = generated | F.coalesce(F.substring(content, 1, 4096).rlike(GENERATED_HEADER), F.lit(False))
    return {
        "is_generated": generated,
        "is_vendor": any_of(parts, VENDOR_PARTS),
        "is_test": any_of(parts, TEST_PARTS) | F.contains(low, F.lit("test")),
        "is_source": lang.isin(*SOURCE),
        "is_build": lang.isin(*BUILD_LANGUAGES) | (name == "Makefile") | F.contains(path, F.lit("/cmake/")) | low.isin(*BUILD_NAMES),
        "is_config": lang.isin(*CONFIG_LANGUAGES) | F.contains(name, F.lit("Config")),
        "is_doc": (lang == "doc") | parts[0].isin(*DOC_ROOTS) | F.lower(suffix(path)).isin(".md", ".rst"),
    }


def content_class(lang, flag: dict[str, Column]) -> Column:
    return reduce(lambda rest, fc: F.when(flag[fc[0]], fc[1]).otherwise(rest), reversed(FLAG_CLASSES), F.lit("other")) if lang is None else F.when(lang == "patch", "patch").otherwise(content_class(None, flag))


def file_role(path, klass) -> Column:
    return (
        F.when(F.contains(path, F.lit("/init.d/")), "runtime-service")
        .when(path.startswith("package/"), "package")
        .when(path.startswith("include/"), "source-include")
        .when(path.startswith("scripts/") | path.startswith("tools/"), "tooling")
        .otherwise(klass)
    )


def signature(sha, blob, size, reason) -> Column:
    """What a file version is told by: its digest, else its blob, else its size and why it was skipped."""
    has = lambda c: c.isNotNull() & (c != "")
    return F.when(has(sha), F.concat(F.lit("sha256:"), sha)).when(has(blob), F.concat(F.lit("blob:"), blob)).otherwise(F.concat(F.lit("meta:"), size.cast("string"), F.lit(":"), F.coalesce(reason, F.lit(""))))


def slug(text) -> Column:
    """A database name: lower case, runs of other characters as _, at most 63 characters with a digest where longer."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.length(plain) <= 63, plain).otherwise(F.concat(F.left(plain, F.lit(54)), F.lit("_"), F.left(F.sha2(text, 256), F.lit(8))))


#: Suffixes and names of texts that are parsed, beyond those of a known language (fixed values).
PARSED_NAMES = "Makefile Kconfig Config.in Config-defaults.in config inittab rc.common sysupgrade .bazelrc BUILD BUILD.bazel WORKSPACE WORKSPACE.bazel MODULE.bazel Jenkinsfile CMakeLists.txt meson.build meson_options.txt Dockerfile Containerfile".split()
PARSED_LANGUAGES = [*SOURCE, *"autotools boot_script cmake config dockerfile meson packer text xml".split()]


def should_parse(path, lang, skipped_reason) -> Column:
    """Whether a file's text is parsed: it was read, and its suffix, name, place or language tells of text."""
    known = [e for ends in SUFFIXES.values() for e in ends.split()] + C_SUFFIXES + [".s", ".S"]
    text = suffix(path).isin(*known) | base_name(path).isin(*PARSED_NAMES) | F.contains(path, F.lit("/files/")) | F.contains(path, F.lit("/base-files/")) | lang.isin(*PARSED_LANGUAGES)
    return (F.coalesce(skipped_reason, F.lit("")) == "") & F.coalesce(text, F.lit(False))
