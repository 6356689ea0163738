"""Code rules as queries over the node table: complexity, React components and effects, and lint rules.

Joins and groups are by file and node, so one partitioning by rel_path serves them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.frontend import conditions
from loomspark.frontend.nodes import FUNCTIONS, LOOPS
from loomspark.frontend.spans import enclosing
from loomspark.plans.store import written

DECISIONS = ("IfStatement", "ConditionalExpression", *LOOPS, "CatchClause")
NESTING = (*LOOPS, "IfStatement", "SwitchStatement", "TryStatement")
# Methods that change an array in place, results of typeof, and names that exist without a declaration.
MUTATING = ["push", "pop", "shift", "unshift", "splice", "sort", "reverse", "fill", "copyWithin"]
TYPEOF = ["undefined", "object", "boolean", "number", "string", "function", "symbol", "bigint"]
GLOBALS = """
undefined NaN Infinity globalThis Object Function Boolean Symbol Error AggregateError EvalError RangeError ReferenceError SyntaxError TypeError URIError Number BigInt Math Date String RegExp Array
Int8Array Uint8Array Uint8ClampedArray Int16Array Uint16Array Int32Array Uint32Array Float32Array Float64Array BigInt64Array BigUint64Array Map Set WeakMap WeakSet WeakRef FinalizationRegistry ArrayBuffer
SharedArrayBuffer DataView Atomics JSON Promise Reflect Proxy Intl WebAssembly eval isFinite isNaN parseFloat parseInt decodeURI decodeURIComponent encodeURI encodeURIComponent escape unescape arguments
console process Buffer global require module exports __dirname __filename setTimeout clearTimeout setInterval clearInterval setImmediate clearImmediate queueMicrotask structuredClone fetch
URL URLSearchParams Headers Request Response FormData Blob File FileReader AbortController AbortSignal TextEncoder TextDecoder Event EventTarget CustomEvent MessageChannel MessagePort Worker WebSocket XMLHttpRequest
window document self navigator location history screen localStorage sessionStorage alert confirm prompt open close print performance crypto atob btoa requestAnimationFrame cancelAnimationFrame requestIdleCallback
addEventListener removeEventListener dispatchEvent postMessage getComputedStyle matchMedia scrollTo innerWidth innerHeight name event parent top origin Image Audio Node Element HTMLElement DocumentFragment
MutationObserver IntersectionObserver ResizeObserver DOMParser IndexedDB indexedDB caches customElements
scrollX scrollY scroll scrollBy pageXOffset pageYOffset outerWidth outerHeight screenX screenY screenLeft screenTop devicePixelRatio visualViewport frames frameElement length opener closed status focus blur stop find
moveTo moveBy resizeTo resizeBy getSelection createImageBitmap reportError isSecureContext crossOriginIsolated scheduler trustedTypes speechSynthesis cookieStore navigation menubar toolbar statusbar scrollbars
personalbar locationbar external clientInformation styleMedia launchQueue sharedStorage documentPictureInPicture showOpenFilePicker showSaveFilePicker showDirectoryPicker queryLocalFonts getScreenDetails
Option Range Selection Text Comment Attr Document DOMException Lock LockManager Cache CacheStorage Clipboard ClipboardItem Notification Plugin Profiler Highlight HighlightRegistry Iterator
AsyncDisposableStack DisposableStack SuppressedError Scheduler Subscriber Observable Ink Sanitizer Viewport Origin CloseEvent CloseWatcher ErrorEvent HashChangeEvent PopStateEvent
""".split()
# How the interfaces of browsers and of the runtime are named; and handlers of the window.
INTERFACES = r"""^(?:AbsoluteOrientation|Accelerometer|Ambient|Analyser|Animation|Attribution|Audio|Authenticator|Background|BarProp|Barcode|BaseAudio|Battery|BeforeInstall|BeforeUnload|Biquad|BlobEvent|Bluetooth|Broadcast|Browser
|ByteLength|CSS|Canvas|Capture|Channel|Character|Clipboard|Close|Composition|Compression|Constant|ContentVisibility|Convolver|Cookie|Count|Credential|Crop|Crypto|Custom|DOM|Data|Decompression|Delay|Delegated|Device|Document|Drag|Dynamics
|EditContext|Element|Encoded|Event|External|EyeDropper|FeaturePolicy|Federated|Fence|Fetch|File|Focus|Font|Form|Fragment|GPU|Gain|Gamepad|Geolocation|Gravity|Gyroscope|HID|HTML|Hash|Headers|History|IDB|IIR|Identity|Idle|Image|Input|Intersection
|Keyboard|Keyframe|Largest|Launch|Layout|Linear|Location|MIDI|Magnetometer|Math|Media|Message|Metadata|Mime|Mouse|Mutation|NamedNode|Navigate|Navigation|Navigator|Network|Node|NotRestored|OTP|Offline|Offscreen|Orientation|Oscillator|Overconstrained
|Page|Paint|Panner|Password|Path2D|Payment|Performance|Periodic|Permission|Picture|Plugin|Pointer|Presentation|Processing|Progress|Promise|Protected|Public|Push|RTC|Radio|Readable|Relative|Remote|Report|Resize|SVG|Screen|Script|Scroll|Security|Sensor
|Serial|Service|Shadow|Shared|Snap|Source|Speech|Static|Stereo|Storage|Style|Submit|Sync|Task|Text|Time|Toggle|Touch|Track|Transform|Transition|Tree|Trusted|UI|URL|USB|User|VTT|Validity|Video|View|Virtual|Visibility|Visual|WGSL|Wake|Wave|Web|Wheel|Window
|Worklet|Writable|XML|XPath|XR|XSLT)(?:[A-Z0-9]\w*|Source|List|)$|^on[a-z]{3,}$|^webkit[A-Z]\w*$""".replace("\n", "")
FINDING = ["source", "rule_id", "severity", "category", "title", "message", "rel_path", "line_start", "column_start", "line_end", "column_end", "suggestion", "fixable"]
COMPLEXITY_LIMITS = {"lines": 80, "params": 5, "cyclomatic": 10, "nesting": 4}
#: Rules of one plan, where many are asked for.
AT_ONCE = 4
REACT_LIMITS = {"component": 200, "effect": 50}


def finding(df: DataFrame, source: str, rule: Column | str, severity: Column | str, category: str, title: Column | str, message: Column, suggestion: Column | str | None = None) -> DataFrame:
    """df has rel_path and the bounds of what is reported."""
    one = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(F.lit(source).alias("source"), one(rule).alias("rule_id"), one(severity).alias("severity"), F.lit(category).alias("category"), one(title).alias("title"), one(message).alias("message"), "rel_path", "line_start", F.col("col_start").alias("column_start"), "line_end", F.col("col_end").alias("column_end"), one(suggestion).cast("string").alias("suggestion"), F.lit(False).alias("fixable"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: What functions() reads of the nodes; see nodes.parsed().
MEASURED = ["rel_path", "node_id", "type", "role", "parent_type", "fn_id", "in_body", "nesting", "label", "line_start", "line_end", "col_start", "col_end", "n_params", "flags"]
_WEIGHED = {*FUNCTIONS, *DECISIONS, *NESTING, "LogicalExpression"}


def weighed(row: dict) -> bool:
    """Whether a node is a function or adds to the measures of one."""
    return row["type"] in _WEIGHED or row["role"] == "test" and row["parent_type"] == "SwitchCase"


def gathered(parts: list[DataFrame]) -> DataFrame:
    """union() of stored findings, AT_ONCE parts at a time: a plan over all rules has hundreds of joins, whose plans, metrics and small tables the driver would hold at once."""
    return union([written(union(parts[i : i + AT_ONCE]), "findings") for i in range(0, len(parts), AT_ONCE)])


def functions(nodes: DataFrame) -> DataFrame:
    """One row per function: name, kind, bounds, lines, params, cyclomatic complexity, nesting, async, generator.

    Complexity counts the decisions of the body without nested functions; where the
    body itself is a function, it counts that one's decisions.
    """
    found = nodes.where(F.col("type").isin(*FUNCTIONS))
    kind = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in FUNCTIONS.items()])
    # a case with a test is counted by that test, besides what the test itself counts
    own = F.when(F.col("type").isin(*DECISIONS, "LogicalExpression"), 1).otherwise(0) + F.when((F.col("role") == "test") & (F.col("parent_type") == "SwitchCase"), 1).otherwise(0)
    depth = F.when(F.col("type").isin(*NESTING), F.col("nesting")).otherwise(0)
    parts = nodes.where("fn_id is not null").groupBy("rel_path", F.col("fn_id").alias("owner")).agg(
        F.sum(F.when(F.col("in_body"), own).otherwise(0)).alias("c_body"), F.sum(own).alias("c_all"), F.max(F.when(F.col("in_body"), depth).otherwise(0)).alias("d_body"), F.max(depth).alias("d_all"),
        F.max(F.when(F.col("type").isin(*FUNCTIONS) & (F.col("role") == "body") & (F.col("parent_type") == "ArrowFunctionExpression"), F.col("node_id"))).alias("inner"),
    )
    metrics = found.join(parts.withColumnRenamed("owner", "node_id"), ["rel_path", "node_id"], "left")
    inner = parts.select("rel_path", F.col("owner").alias("inner"), F.col("c_all").alias("c_inner"), F.col("d_all").alias("d_inner"))
    metrics = metrics.join(inner, ["rel_path", "inner"], "left")
    whole = lambda a, b: F.coalesce(F.when(F.col("inner").isNotNull(), F.coalesce(a, F.lit(0))).otherwise(b), F.lit(0))
    return metrics.select(
        "rel_path", "node_id", F.col("label").alias("name"), kind.alias("kind"), "line_start", "line_end", "col_start", "col_end", (F.col("line_end") - F.col("line_start") + 1).alias("lines"), F.col("n_params").alias("params"),
        (whole(F.col("c_inner"), F.col("c_body")) + 1).cast("int").alias("cyclomatic"), whole(F.col("d_inner"), F.col("d_body")).cast("int").alias("nesting"), F.array_contains("flags", "async").alias("is_async"), F.array_contains("flags", "generator").alias("is_generator"),
    )


def complexity_findings(nodes: DataFrame, limits: dict[str, int] = COMPLEXITY_LIMITS) -> DataFrame:
    f = functions(nodes)
    # Rule, title, message and suggestion of each measure.
    rules = [
        ("lines", "complexity/function-too-long", "Function exceeds maximum line length", "has %d lines", "Break the function into smaller, focused helper functions."),
        ("params", "complexity/too-many-parameters", "Function has too many parameters", "has %d parameters", "Group related parameters into an options object or cohesive data structure."),
        ("cyclomatic", "complexity/high-cyclomatic-complexity", "High cyclomatic complexity", "has cyclomatic complexity %d", "Break the decision logic into smaller focused functions or dispatch tables."),
        ("nesting", "complexity/deep-nesting", "Deep decision nesting", "has a nesting depth of %d", "Use guard clauses, early returns, or extract nested blocks into helper functions."),
    ]
    told = []
    for measure, rule, title, says, suggestion in rules:
        most, m = limits[measure], F.col(measure)
        severity = F.when(m >= 2 * most, "high").otherwise("medium")
        severity = F.when(m >= 2 * most, "high").when(m == most + 1, "low").otherwise("medium") if measure == "params" else severity
        message = F.format_string(f"Function '%s' {says}, exceeding the configured maximum of {most}.", "name", m)
        told.append(F.when(m > most, F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), F.lit(title).alias("title"), message.alias("message"), F.lit(suggestion).alias("suggestion"))))
    # functions are measured once for all rules
    each = f.withColumn("told", F.explode(F.array_compact(F.array(*told))))
    return finding(each, "complexity", F.col("told.rule"), F.col("told.severity"), "maintainability", F.col("told.title"), F.col("told.message"), F.col("told.suggestion"))


def _react_names(nodes: DataFrame) -> DataFrame:
    """rel_path, local, known: what files import from 'react' by name."""
    imports = nodes.where("type = 'ImportDeclaration' and value = 'react'").select("rel_path", F.col("node_id").alias("grand_id"))
    local = nodes.where("parent_type = 'ImportSpecifier' and role = 'local'").select("rel_path", "parent_id", "grand_id", F.col("name").alias("local"))
    known = nodes.where("type = 'ImportSpecifier'").select("rel_path", F.col("node_id").alias("parent_id"), F.col("name").alias("known"))
    return local.join(imports, ["rel_path", "grand_id"], "left_semi").join(known, ["rel_path", "parent_id"]).select("rel_path", "local", "known").distinct()


def _named(nodes: DataFrame, names: DataFrame, what: str) -> DataFrame:
    """Rows of nodes whose path is `what`, React.`what` or a local name for it."""
    alias = names.where(F.col("known") == what).select("rel_path", F.col("local").alias("path"), F.lit(True).alias("aliased"))
    return nodes.join(alias, ["rel_path", "path"], "left").where(F.col("aliased") | F.col("path").isin(what, f"React.{what}")).drop("aliased")


def components(nodes: DataFrame) -> DataFrame:
    """rel_path, node_id, name, kind and bounds of React components; a wrapped one has the bounds of its wrapper call."""
    names = _react_names(nodes)
    bounds = ["line_start", "col_start", "line_end", "col_end"]
    supers = nodes.where("role = 'superClass' and parent_type = 'ClassDeclaration'")
    alias = names.where("known in ('Component', 'PureComponent')").select("rel_path", F.col("local").alias("path"), F.lit(True).alias("aliased"))
    supers = supers.join(alias, ["rel_path", "path"], "left").where("aliased or path in ('React.Component', 'React.PureComponent')").select("rel_path", F.col("parent_id").alias("node_id")).distinct()
    classes = nodes.where("type = 'ClassDeclaration'").join(supers, ["rel_path", "node_id"], "left_semi").select("rel_path", "node_id", F.coalesce("name", F.lit("<anonymous-class-component>")).alias("name"), F.lit("class-component").alias("kind"), *bounds)
    # functions that return elements: at once, or by a return statement of their own
    made = (F.col("type").isin("JSXElement", "JSXFragment")) | ((F.col("type") == "CallExpression") & F.col("path").isin("createElement", "React.createElement"))
    by_return = nodes.where(made & (F.col("parent_type") == "ReturnStatement") & F.col("fn_id").isNotNull()).select("rel_path", F.col("fn_id").alias("node_id"))
    at_once = nodes.where(made & (F.col("role") == "body") & (F.col("parent_type") == "ArrowFunctionExpression")).select("rel_path", F.col("parent_id").alias("node_id"))
    through = nodes.where(F.col("type").isin(*FUNCTIONS) & (F.col("role") == "body")).select("rel_path", "node_id", "parent_id")
    direct = by_return.unionByName(at_once)
    nested = through.join(direct, ["rel_path", "node_id"]).select("rel_path", F.col("parent_id").alias("node_id"))
    returns = direct.unionByName(nested).distinct()
    f = nodes.where("type in ('FunctionDeclaration', 'FunctionExpression', 'ArrowFunctionExpression')").join(returns, ["rel_path", "node_id"], "left_semi")
    calls = nodes.where("type = 'CallExpression'").select("rel_path", F.col("node_id").alias("parent_id"), F.col("path").alias("callee"), F.col("parent_id").alias("call_parent"), F.col("parent_type").alias("call_parent_type"), F.struct(*bounds).alias("call"))
    f = f.join(calls, ["rel_path", "parent_id"], "left")
    wrap = F.when((F.col("role") == "argument") & (F.col("idx") == 0), F.when(F.col("callee").isin("memo", "React.memo"), "memo-component").when(F.col("callee").isin("forwardRef", "React.forwardRef"), "forward-ref-component"))
    f = f.withColumn("wrap", wrap).withColumn("holder", F.when((F.col("wrap").isNotNull()) & (F.col("call_parent_type") == "VariableDeclarator"), F.col("call_parent")).when(F.col("parent_type") == "VariableDeclarator", F.col("parent_id")))
    ids = nodes.where("parent_type = 'VariableDeclarator' and role = 'id' and type = 'Identifier'").select("rel_path", F.col("parent_id").alias("holder"), F.col("name").alias("held_name"))
    f = f.join(ids, ["rel_path", "holder"], "left")
    own = F.when(F.col("type") == "FunctionDeclaration", F.col("name")).when(F.col("holder").isNotNull(), F.col("held_name")).when(F.col("parent_type") == "ExportDefaultDeclaration", F.col("name"))
    place = [F.when(F.col("wrap").isNotNull(), F.col("call")[b]).otherwise(F.col(b)).alias(b) for b in bounds]
    found = f.withColumn("component", own).where("component rlike '^[A-Z]'").select("rel_path", "node_id", F.col("component").alias("name"), F.coalesce("wrap", F.lit("function-component")).alias("kind"), *place)
    return classes.unionByName(found)


def states(nodes: DataFrame) -> DataFrame:
    """rel_path, state_id, state_name, setter_name and line of [state, setter] = useState()."""
    calls = _named(nodes.where("type = 'CallExpression' and role = 'init'"), _react_names(nodes), "useState").select("rel_path", F.col("parent_id").alias("grand_id"))
    parts = nodes.where("parent_type = 'ArrayPattern' and role = 'element' and type = 'Identifier' and grand_type = 'VariableDeclarator' and idx < 2").join(calls, ["rel_path", "grand_id"], "left_semi")
    pick = lambda k, c: F.max(F.when(F.col("idx") == k, F.col(c)))
    out = parts.groupBy("rel_path", "grand_id").agg(pick(0, "node_id").alias("state_id"), pick(0, "name").alias("state_name"), F.coalesce(pick(1, "name"), F.lit("")).alias("setter_name"))
    lines = nodes.where("type = 'VariableDeclarator'").select("rel_path", F.col("node_id").alias("grand_id"), F.col("line_start").alias("line"))
    return out.where("state_id is not null").join(lines, ["rel_path", "grand_id"]).drop("grand_id")


def effects(nodes: DataFrame) -> DataFrame:
    """Callbacks of useEffect that are written in place: their bounds, callback_lines, is_async."""
    calls = _named(nodes.where("type = 'CallExpression'"), _react_names(nodes), "useEffect").select("rel_path", F.col("node_id").alias("parent_id"), F.col("line_start").alias("effect_start"), F.col("line_end").alias("effect_end"))
    f = nodes.where("role = 'argument' and idx = 0 and type in ('FunctionExpression', 'ArrowFunctionExpression')")
    return f.join(calls, ["rel_path", "parent_id"]).select("rel_path", "node_id", "effect_start", "effect_end", "line_start", "col_start", "line_end", "col_end", (F.col("line_end") - F.col("line_start") + 1).alias("callback_lines"), F.array_contains("flags", "async").alias("is_async"))


def react_findings(nodes: DataFrame, limits: dict[str, int] = REACT_LIMITS) -> DataFrame:
    large = lambda m, most: F.when(m >= 2 * most, "high").otherwise("medium")
    lines, most = F.col("line_end") - F.col("line_start") + 1, limits["component"]
    out = [finding(components(nodes).where(lines > most), "react", "react/component-too-large", large(lines, most), "maintainability", "Large React component", F.format_string(f"Component '%s' spans %d lines, exceeding the configured maximum of {most}.", "name", lines), "Extract cohesive UI sections, state logic, or side effects into smaller components and custom Hooks.")]
    # reads of a state climb to the end of their member chain; what holds that chain tells the change
    uses = nodes.where("access in ('r', 'rw', 'w') and chain_id is not null").select("rel_path", F.col("binding_id").alias("state_id"), F.col("node_id").alias("use_id"), F.col("chain_id").alias("node_id"), F.col("access"))
    uses = uses.join(states(nodes), ["rel_path", "state_id"])
    chain = nodes.select("rel_path", "node_id", F.col("type").alias("chain_type"), F.col("name").alias("last"), F.col("role").alias("chain_role"), "parent_id", "parent_type")
    uses = uses.join(chain, ["rel_path", "node_id"])
    member = F.col("chain_type") == "MemberExpression"
    how = (
        F.when(member & (F.col("parent_type") == "CallExpression") & (F.col("chain_role") == "callee") & F.col("last").isin(*MUTATING), F.concat(F.lit("'"), F.col("last"), F.lit("'")))
        .when(member & (F.col("parent_type") == "AssignmentExpression") & (F.col("chain_role") == "left"), "assignment").when(F.col("parent_type") == "UpdateExpression", "an update expression")
    )
    hit = uses.withColumn("how", how).where("how is not null").select("rel_path", "parent_id", "state_id", "state_name", "how").distinct()
    place = nodes.select("rel_path", F.col("node_id").alias("parent_id"), "line_start", "col_start", "line_end", "col_end")
    out.append(finding(hit.join(place, ["rel_path", "parent_id"]), "react", "react/direct-state-mutation", "high", "correctness", "Direct React state mutation", F.format_string("React state '%s' is mutated directly through %s.", "state_name", "how"), "Create a new value and pass it to the state setter instead of mutating React state directly."))
    e, most = effects(nodes), limits["effect"]
    out.append(finding(e.where("is_async"), "react", "react/async-effect-callback", "high", "correctness", "Async useEffect callback", F.lit("The useEffect callback is async and therefore returns a Promise instead of an effect cleanup function."), "Define and call an async function inside the effect while keeping the effect callback synchronous."))
    size = F.col("callback_lines")
    out.append(finding(e.where(size > most), "react", "react/effect-too-large", large(size, most), "maintainability", "Large useEffect callback", F.format_string(f"The useEffect callback spans %d lines, exceeding the configured maximum of {most}.", size), "Extract the effect’s work into focused functions or a custom Hook."))
    # key={i} where i is the second parameter of a callback of map
    maps = nodes.where("role = 'callee' and parent_type = 'CallExpression' and type = 'MemberExpression' and name = 'map'").select("rel_path", F.col("parent_id").alias("grand_id"))
    index = nodes.where("role = 'param' and idx = 1 and type = 'Identifier' and parent_type in ('FunctionExpression', 'ArrowFunctionExpression') and parent_role = 'argument' and grand_type = 'CallExpression'")
    first = nodes.where("role = 'argument' and idx = 0").select("rel_path", F.col("node_id").alias("parent_id"))
    index = index.join(first, ["rel_path", "parent_id"], "left_semi").join(maps, ["rel_path", "grand_id"], "left_semi").select("rel_path", F.col("node_id").alias("binding_id"))
    keys = nodes.where("type = 'Identifier' and role = 'expression' and parent_type = 'JSXExpressionContainer' and parent_role = 'value' and grand_type = 'JSXAttribute'").join(index, ["rel_path", "binding_id"], "left_semi").select("rel_path", F.col("grand_id").alias("node_id"), F.col("name").alias("index"))
    keys = nodes.where("type = 'JSXAttribute' and name = 'key'").join(keys, ["rel_path", "node_id"])
    out.append(finding(keys, "react", "react/array-index-key", "medium", "correctness", "Array index used as React key", F.format_string("Array index '%s' is used as a React key.", "index"), "Use a stable identifier from the item instead of its array position."))
    return union(out)


# Severity, category and title of each lint rule. Where a rule has a narrower form than its name says, lint_findings says so.
LINT = {
    "no-undef": ("high", "correctness", "Undefined identifier"), "no-unreachable": ("high", "correctness", "Unreachable code"), "no-dupe-keys": ("high", "correctness", "Duplicate object key"),
    "no-dupe-args": ("high", "correctness", "Duplicate function argument"), "no-dupe-else-if": ("high", "correctness", "Duplicate condition in if-else"), "no-duplicate-case": ("high", "correctness", "Duplicate case label"),
    "no-self-assign": ("high", "correctness", "Self-assignment"), "no-self-compare": ("high", "correctness", "Self-comparison"), "no-constant-condition": ("medium", "correctness", "Constant condition"),
    "valid-typeof": ("high", "correctness", "Invalid typeof comparison"), "use-isnan": ("high", "correctness", "Incorrect NaN comparison"), "no-sparse-arrays": ("medium", "correctness", "Sparse array"),
    "no-cond-assign": ("high", "correctness", "Assignment in condition"), "eqeqeq": ("medium", "correctness", "Suspicious equality"), "no-unused-vars": ("medium", "maintainability", "Unused variable"),
    "no-empty-pattern": ("medium", "correctness", "Empty destructuring pattern"), "no-func-assign": ("high", "correctness", "Reassignment of function declaration"), "no-import-assign": ("high", "correctness", "Assignment to imported binding"),
    "no-setter-return": ("high", "correctness", "Return from setter"), "no-constructor-return": ("high", "correctness", "Return in constructor"),
    "no-unsafe-finally": ("high", "correctness", "Unsafe finally block"), "no-fallthrough": ("medium", "correctness", "Switch case fallthrough"), "no-invalid-regexp": ("high", "correctness", "Invalid regular expression"),
    "no-control-regex": ("medium", "correctness", "Control character in regular expression"), "no-unexpected-multiline": ("high", "correctness", "Unexpected multiline expression"),
    "no-constant-binary-expression": ("medium", "correctness", "Constant binary expression"), "no-loss-of-precision": ("medium", "correctness", "Loss of precision"),
    "no-unmodified-loop-condition": ("medium", "correctness", "Unmodified loop condition"), "react-hooks/rules-of-hooks": ("high", "correctness", "Invalid React Hook usage"),
    "react-hooks/exhaustive-deps": ("medium", "correctness", "Incomplete React Hook dependencies"),
}


def _pairs(nodes: DataFrame, parents: DataFrame, a: str, b: str) -> DataFrame:
    """parents with the children of roles a and b as structs."""
    held = F.struct("type", "name", "op", "value", "path", "shape", "node_id", "line_start", "col_start")
    kids = nodes.where(F.col("role").isin(a, b)).groupBy("rel_path", F.col("parent_id").alias("node_id")).agg(F.max(F.when(F.col("role") == a, held)).alias("a"), F.max(F.when(F.col("role") == b, held)).alias("b"))
    return parents.join(kids, ["rel_path", "node_id"])


def lint_findings(nodes: DataFrame, rules: list[str] | None = None, known: tuple[str, ...] = ()) -> DataFrame:
    """Findings of the lint rules (all of LINT if none are named).

    known: names that exist besides GLOBALS and what is named like an interface of a browser (INTERFACES, a rule, so that it lets
    some names through that no browser has). no-unreachable sees the first of each run of statements after one that never completes (jumps, branches, loops
    without end, switches, try), not single expressions; no-dupe-else-if compares conditions as sets of conjuncts, no-self-assign patterns three levels
    deep, both by their trees; no-constant-condition folds conditions from their leaves. no-invalid-regexp checks structure and flags; no-constant-binary-expression
    compares operands by their kind, not their value; no-unmodified-loop-condition skips tests with calls or members; the Hook
    rules follow the enclosing branches, loops and returns of a call, and exhaustive-deps dotted paths.
    """
    made = {}
    n = nodes.where("type <> '#failure'")
    around = _around(n)
    say = lambda fmt, *c: F.format_string(fmt, *c)
    unknown = n.where("access is not null and access <> 'd' and binding_id is null and not array_contains(flags, 'typeof')").where(~F.col("name").isin(*GLOBALS, *known) & ~F.col("name").rlike(INTERFACES))
    made["no-undef"] = unknown, say("'%s' is not defined.", F.col("name"))
    jumps = n.where("array_contains(flags, 'abrupt') and role in ('body', 'consequent') and parent_type in ('BlockStatement', 'Program', 'SwitchCase')").groupBy("rel_path", "parent_id", "role").agg(F.min("idx").alias("jump"))
    filled = n.where("role = 'init' and parent_type = 'VariableDeclarator'").select("rel_path", F.col("grand_id").alias("node_id"), F.lit(True).alias("filled")).distinct()
    after = n.join(jumps, ["rel_path", "parent_id", "role"]).where("idx > jump and type not in ('FunctionDeclaration', 'EmptyStatement')").join(filled, ["rel_path", "node_id"], "left")
    after = after.where("type <> 'VariableDeclaration' or op <> 'var' or filled")
    follows = F.lag("idx").over(Window.partitionBy("rel_path", "parent_id", "role").orderBy("idx"))
    after = after.withColumn("follows", follows).where("follows is null or follows < idx - 1")
    made["no-unreachable"] = after, F.lit("Unreachable code.")
    again = lambda df, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy("rel_path", *by).orderBy("node_id"))).where("nth > 1")
    keys = n.where("type in ('ObjectProperty', 'ObjectMethod') and parent_type = 'ObjectExpression' and name is not null and not (name = '__proto__' and type = 'ObjectProperty')")
    accessor = F.when(F.col("op").isin("get", "set"), F.col("op")).otherwise("value")
    made["no-dupe-keys"] = again(keys.withColumn("kind", accessor), "parent_id", "name", "kind"), say("Duplicate key '%s'.", F.col("name"))
    made["no-dupe-args"] = again(n.where("access = 'd' and binding_kind = 'param'"), "fn_id", "name").where("fn_id is not null"), say("Duplicate param '%s'.", F.col("name"))
    cases = again(n.where("role = 'test' and parent_type = 'SwitchCase'"), "grand_id", "shape").select("rel_path", F.col("parent_id").alias("node_id"))
    made["no-duplicate-case"] = n.join(cases, ["rel_path", "node_id"]), F.lit("Duplicate case label.")
    made["no-dupe-else-if"] = n.join(conditions.covered(n, around), ["rel_path", "node_id"], "left_semi"), F.lit("This branch can never execute. Its condition is a duplicate or covered by previous conditions in the if-else-if chain.")
    sides = _pairs(n, n.where("type = 'AssignmentExpression' and op = '=' or type = 'BinaryExpression'"), "left", "right")
    made["no-self-assign"] = _self_assigned(n), say("'%s' is assigned to itself.", F.col("said"))
    compare = sides.where("type = 'BinaryExpression' and op in ('==', '!=', '===', '!==', '<', '>', '<=', '>=')")
    made["no-self-compare"] = compare.where("a.shape = b.shape"), F.lit("Comparing to itself is potentially pointless.")
    nan = n.where("path in ('NaN', 'Number.NaN') and type in ('Identifier', 'MemberExpression')")
    # Messages.
    in_switch = F.when((F.col("role") == "discriminant") & (F.col("parent_type") == "SwitchStatement"), "'switch(NaN)' can never match a case clause. Use Number.isNaN instead of the switch.").when((F.col("role") == "test") & (F.col("parent_type") == "SwitchCase"), "'case NaN' can never match. Use Number.isNaN before the switch.")
    switched = n.join(nan.select("rel_path", F.col("parent_id").alias("node_id"), in_switch.alias("said")).where("said is not null"), ["rel_path", "node_id"])
    compared = compare.where("a.path in ('NaN', 'Number.NaN') or b.path in ('NaN', 'Number.NaN')").select(*n.columns, F.lit("Use the isNaN function to compare with NaN.").alias("said"))
    made["use-isnan"] = compared.unionByName(switched.select(*n.columns, "said")), F.col("said")
    literal = lambda s, o: (F.col(f"{s}.type") == "UnaryExpression") & (F.col(f"{s}.op") == "typeof") & (F.col(f"{o}.type") == "StringLiteral") & ~F.col(f"{o}.value").isin(*TYPEOF)
    made["valid-typeof"] = compare.where("op in ('==', '!=', '===', '!==')").where(literal("a", "b") | literal("b", "a")), F.lit("Invalid typeof comparison value.")
    made["eqeqeq"] = compare.where("op in ('==', '!=')"), say("Expected '%s=' and instead saw '%s'.", F.col("op"), F.col("op"))
    test = (F.col("role") == "test") & F.col("parent_type").isin("IfStatement", "ConditionalExpression", "WhileStatement", "DoWhileStatement", "ForStatement")
    # a loop over the literal true is a usual idiom
    usual = (F.col("value") == "true") & (F.col("type") == "BooleanLiteral") & F.col("parent_type").isin("WhileStatement", "DoWhileStatement", "ForStatement")
    made["no-constant-condition"] = n.where(test & ~usual).join(conditions.constant(n, around), ["rel_path", "node_id"], "left_semi"), F.lit("Unexpected constant condition.")
    made["no-cond-assign"] = n.where(test & (F.col("type") == "AssignmentExpression") & ~F.array_contains("flags", "paren")), F.lit("Expected a conditional expression and instead saw an assignment.")
    holes = n.where("type = 'Hole' and parent_type = 'ArrayExpression'").select("rel_path", F.col("parent_id").alias("node_id")).distinct()
    made["no-sparse-arrays"] = n.join(holes, ["rel_path", "node_id"]), F.lit("Unexpected comma in middle of array.")
    made["no-empty-pattern"] = n.where("type in ('ObjectPattern', 'ArrayPattern') and last_id = node_id"), say("Unexpected empty %s pattern.", F.when(F.col("type") == "ObjectPattern", "object").otherwise("array"))
    writes = n.where("access in ('w', 'rw')")
    made["no-func-assign"] = writes.where("binding_kind in ('function')"), say("'%s' is a function.", F.col("name"))
    made["no-import-assign"] = writes.where("binding_kind = 'import'"), say("'%s' is read-only.", F.col("name"))
    returns = n.where("type = 'ReturnStatement' and last_id > node_id")
    owner = n.where("op in ('set', 'constructor') and type in ('ClassMethod', 'ClassPrivateMethod', 'ObjectMethod')").select("rel_path", F.col("node_id").alias("fn_id"), F.col("op").alias("owner"))
    owned = returns.join(owner, ["rel_path", "fn_id"])
    made["no-setter-return"] = owned.where("owner = 'set'"), F.lit("Setter cannot return a value.")
    made["no-constructor-return"] = owned.where("owner = 'constructor'"), F.lit("Unexpected return statement in constructor.")
    made |= _more_lint(n, sides, around)
    made["no-unused-vars"] = _unused(n), F.when(F.col("written"), say("'%s' is assigned a value but never used.", F.col("name"))).otherwise(say("'%s' is defined but never used.", F.col("name")))
    parts = []
    for rule in rules if rules is not None else LINT:
        severity, category, title = LINT[rule]
        df, message = made[rule]
        parts.append(finding(df, "eslint", rule, severity, category, title, message))
    return gathered(parts) if len(parts) > AT_ONCE else union(parts)


def _around(n: DataFrame) -> DataFrame:
    """Stored: the enclosing nodes that the rules ask for (see spans.enclosing)."""
    role, kind, up = F.col("role"), F.col("type"), F.col("parent_type")
    marks = {
        "finals": role == "finalizer", "loops": kind.isin(*LOOPS), "switches": kind == "SwitchStatement", "labels": kind == "LabeledStatement",
        "branches": role.isin("consequent", "alternate") & up.isin("IfStatement", "ConditionalExpression") | (role == "right") & (up == "LogicalExpression") | (role == "consequent") & (up == "SwitchCase"),
        "tests": (role == "test") & up.isin("IfStatement", "ConditionalExpression", "WhileStatement", "DoWhileStatement", "ForStatement"),
        "callbacks": (role == "argument") & (F.col("idx") == 0) & kind.isin("FunctionExpression", "ArrowFunctionExpression"),
    }
    return written(enclosing(n, {k: F.coalesce(m, F.lit(False)) for k, m in marks.items()}, ("finals", "loops", "switches", "labels", "branches")), "around")


def _self_assigned(n: DataFrame) -> DataFrame:
    """Targets of assignments (said: their path) that stand at the same place of the assigned value."""
    held = ["node_id", "type", "path", "shape", "line_start", "col_start", "line_end", "col_end"]
    side = lambda df, s, *by: df.select("rel_path", *by, *[F.col(c).alias(f"{s}_{c}") for c in held])
    whole = n.where("type = 'AssignmentExpression' and op in ('=', '&&=', '||=', '??=')").select("rel_path", F.col("node_id").alias("of"))
    child = lambda role, s: side(n.where((F.col("role") == role) & (F.col("parent_type") == "AssignmentExpression")), s, F.col("parent_id").alias("of"))
    pairs = whole.join(child("left", "a"), ["rel_path", "of"]).join(child("right", "b"), ["rel_path", "of"]).drop("of")
    # elements by their place, properties by their name; behind a spread places and names are open
    spread = n.where("type = 'SpreadElement'").groupBy("rel_path", F.col("parent_id").alias("up")).agg(F.min("idx").alias("first_spread"), F.max("node_id").alias("last_spread"))
    element = n.where("role = 'element' and parent_type in ('ArrayPattern', 'ArrayExpression')").select("*", F.concat(F.lit("#"), F.col("idx").cast("string")).alias("place"), F.col("parent_id").alias("up"), F.col("idx").alias("nth"))
    names = n.where("type = 'ObjectProperty' and name is not null and not array_contains(flags, 'computed')").select("rel_path", F.col("node_id").alias("parent_id"), F.concat(F.lit("."), "name").alias("place"), F.col("parent_id").alias("up"))
    value = n.where("role = 'value' and parent_type = 'ObjectProperty'").join(names, ["rel_path", "parent_id"]).withColumn("nth", F.lit(-1))
    inner = element.unionByName(value.select(element.columns)).join(spread, ["rel_path", "up"], "left").where("nth < 0 and (last_spread is null or node_id > last_spread) or nth >= 0 and (first_spread is null or nth < first_spread)")
    out = pairs
    for _ in range(3):
        left = side(inner, "x", F.col("up").alias("a_node_id"), "place")
        right = side(inner, "y", F.col("up").alias("b_node_id"), "place")
        fits = pairs.where("a_type = 'ArrayPattern' and b_type = 'ArrayExpression' or a_type = 'ObjectPattern' and b_type = 'ObjectExpression'").select("rel_path", "a_node_id", "b_node_id")
        pairs = fits.join(left, ["rel_path", "a_node_id"]).join(right, ["rel_path", "b_node_id", "place"])
        pairs = pairs.select("rel_path", *[F.col(f"{x}_{c}").alias(f"{s}_{c}") for s, x in (("a", "x"), ("b", "y")) for c in held])
        out = out.unionByName(pairs)
    return out.where("a_shape = b_shape and a_path is not null").select("rel_path", F.col("a_path").alias("said"), *[F.col(f"b_{c}").alias(c) for c in ("line_start", "col_start", "line_end", "col_end")])


def _flag(prefix: str) -> Column:
    """What follows prefix in a node's flags, or null."""
    return F.get(F.transform(F.filter("flags", lambda f: f.startswith(prefix)), lambda f: F.substring(f, len(prefix) + 1, 1_000_000)), F.lit(0))


def _more_lint(n: DataFrame, sides: DataFrame, around: DataFrame) -> dict[str, tuple[DataFrame, Column]]:
    """Rules on jumps, literals, constant operands and loop conditions, and the Hook rules: what is reported and how."""
    made = {}
    # a jump that leaves a finally block: of its own function, and not to a loop, switch or label inside the block
    jumps = n.where("type in ('ReturnStatement', 'ThrowStatement', 'BreakStatement', 'ContinueStatement')").join(around.where(F.size("finals") > 0).select("rel_path", "node_id", "finals", "loops", "switches", "labels"), ["rel_path", "node_id"])
    beyond = lambda c: F.filter(c, lambda x: x > F.element_at("finals", -1))
    stays = F.col("name").isNull() & (F.col("type").isin("BreakStatement", "ContinueStatement") & (F.size(beyond("loops")) > 0) | (F.col("type") == "BreakStatement") & (F.size(beyond("switches")) > 0))
    label = n.where("type = 'LabeledStatement'").select("rel_path", F.col("node_id").alias("label_id"), "name")
    named = jumps.where("name is not null").select("rel_path", "node_id", "name", F.explode(beyond("labels")).alias("label_id")).join(label, ["rel_path", "label_id", "name"])
    made["no-unsafe-finally"] = jumps.where(~stays).join(named.select("rel_path", "node_id"), ["rel_path", "node_id"], "left_anti"), F.format_string("Unsafe usage of %s.", F.col("type"))
    tests = n.where("role = 'test' and parent_type = 'SwitchCase'").select("rel_path", F.col("parent_id").alias("node_id"), F.lit(True).alias("has_test"))
    made["no-fallthrough"] = n.where("type = 'SwitchCase' and array_contains(flags, 'fallen-into')").join(tests, ["rel_path", "node_id"], "left"), F.concat(F.lit("Expected a 'break' statement before '"), F.when(F.col("has_test"), "case").otherwise("default"), F.lit("'."))
    said = lambda prefix: n.withColumn("said", _flag(prefix)).where("said is not null")
    made["no-invalid-regexp"] = said("regex:"), F.concat("said", F.lit("."))
    made["no-control-regex"] = said("control:"), F.concat(F.lit("Unexpected control character(s) in regular expression: "), "said", F.lit("."))
    made["no-unexpected-multiline"] = said("newline:"), F.concat(F.lit("Unexpected newline "), "said", F.lit("."))
    made["no-loss-of-precision"] = n.where("array_contains(flags, 'imprecise')"), F.lit("This number literal will lose precision at runtime.")
    made["no-constant-binary-expression"] = _constant_operands(n, sides)
    made["no-unmodified-loop-condition"] = _unmodified(n, around), F.format_string("'%s' is not modified in this loop.", F.col("name"))
    made["react-hooks/rules-of-hooks"] = _hook_calls(n, around)
    made["react-hooks/exhaustive-deps"] = _hook_dependencies(n, around)
    return made


NEW = ("ObjectExpression", "ArrayExpression", "ArrowFunctionExpression", "FunctionExpression", "ClassExpression", "NewExpression", "RegExpLiteral")
PLAIN = ("StringLiteral", "NumericLiteral", "BooleanLiteral", "BigIntLiteral")


def _constant_operands(n: DataFrame, sides: DataFrame) -> tuple[DataFrame, Column]:
    logical = _pairs(n, n.where("type = 'LogicalExpression'"), "left", "right")
    kind, op = F.col("a.type"), F.col("op")
    nullish = lambda s: (F.col(f"{s}.type") == "NullLiteral") | (F.col(f"{s}.path") == "undefined") | (F.col(f"{s}.type") == "UnaryExpression") & (F.col(f"{s}.op") == "void")
    never_null = lambda s: F.col(f"{s}.type").isin(*NEW, *PLAIN, "TemplateLiteral", "BinaryExpression", "UpdateExpression") | (F.col(f"{s}.type") == "UnaryExpression")
    truth = kind.isin(*NEW, *PLAIN, "NullLiteral") | (F.col("a.path") == "undefined") | (kind == "UnaryExpression") & F.col("a.op").isin("typeof", "void")
    short = F.when(op.isin("&&", "||") & truth, "truthiness").when((op == "??") & (nullish("a") | never_null("a")), "nullishness")
    left = logical.withColumn("said", F.format_string("Unexpected constant %s on the left-hand side of a `%s` expression.", short, op)).where(short.isNotNull())
    new = lambda s: F.coalesce(F.col(f"{s}.type").isin(*NEW), F.lit(False))
    other = F.when(nullish("a") & (nullish("b") | never_null("b")), "left").when(nullish("b") & never_null("a"), "right")
    told = (
        F.when(op.isin("==", "!=") & new("a") & new("b") | op.isin("===", "!==") & new("a") & new("b"), "Unexpected comparison of two newly constructed objects. These two values can never be equal.")
        .when(other.isNotNull(), F.format_string("Unexpected constant binary expression. Compares constantly with the %s-hand side of the `%s`.", other, op)).when(op.isin("===", "!==") & (new("a") | new("b")), "Unexpected comparison to newly constructed object. These two values can never be equal.")
    )
    compared = sides.where("type = 'BinaryExpression' and op in ('==', '!=', '===', '!==')").withColumn("said", told).where("said is not null")
    return left.unionByName(compared), F.col("said")


def _unmodified(n: DataFrame, around: DataFrame) -> DataFrame:
    """Names in the tests of while, do and for loops that nothing in the loop writes, nor a function that the loop calls; one written operand of a comparison clears the others."""
    loops = n.where("type in ('WhileStatement', 'DoWhileStatement', 'ForStatement')").select("rel_path", F.col("node_id").alias("loop"), F.col("last_id").alias("loop_last"))
    tests = n.where("role = 'test' and parent_type in ('WhileStatement', 'DoWhileStatement', 'ForStatement')").select("rel_path", F.col("node_id").alias("t"), F.col("parent_id").alias("loop"))
    parts = n.select("rel_path", "node_id", "type", "name", "access", "binding_id", "parent_id", "parent_type").join(around.select("rel_path", "node_id", F.explode("tests").alias("t")), ["rel_path", "node_id"]).join(tests, ["rel_path", "t"])
    live = parts.where(F.col("type").isin("CallExpression", "NewExpression", "MemberExpression", "OptionalMemberExpression", "OptionalCallExpression", "TaggedTemplateExpression", "YieldExpression", "AwaitExpression", "UpdateExpression", "AssignmentExpression")).select("rel_path", "t").distinct()
    names = parts.where("access = 'r' and binding_id is not null").join(live, ["rel_path", "t"], "left_anti").join(loops, ["rel_path", "loop"])
    names = names.withColumn("held", F.when(F.col("parent_type") == "BinaryExpression", F.col("parent_id")).otherwise(F.col("node_id")))
    writes = n.where("access in ('w', 'rw') and binding_id is not null").select("rel_path", "binding_id", F.col("node_id").alias("w"), F.col("fn_id").alias("w_fn"))
    direct = names.join(writes, ["rel_path", "binding_id"]).where("w between loop and loop_last")
    # writes in a declared function that the loop names
    own = n.where("access = 'd' and binding_kind = 'function' and role = 'id'").select("rel_path", F.col("node_id").alias("f"), F.col("parent_id").alias("w_fn"))
    called = n.where("access = 'r' and binding_kind = 'function'").select("rel_path", F.col("binding_id").alias("f"), F.col("node_id").alias("call_id"))
    through = names.join(writes.join(own, ["rel_path", "w_fn"]).join(called, ["rel_path", "f"]), ["rel_path", "binding_id"]).where("call_id between loop and loop_last")
    fine = direct.select("rel_path", "loop", "held").unionByName(through.select("rel_path", "loop", "held")).distinct()
    hit = names.join(fine, ["rel_path", "loop", "held"], "left_anti").select("rel_path", "node_id").distinct()
    return n.join(hit, ["rel_path", "node_id"], "left_semi")


def _hook_calls(n: DataFrame, around: DataFrame) -> tuple[DataFrame, Column]:
    calls = n.where("type = 'CallExpression'").where(F.col("path").rlike(r"^(?:[A-Z]\w*\.)?(?:use[A-Z0-9]\w*|use)$"))
    callee = n.where("role = 'callee' and parent_type = 'CallExpression'").select("rel_path", F.col("parent_id").alias("node_id"), *[F.col(c).alias(f"c_{c}") for c in ("line_start", "col_start", "line_end", "col_end")])
    calls = calls.select("rel_path", "node_id", "fn_id", "class_id", "path").join(callee, ["rel_path", "node_id"])
    owner = n.where(F.col("type").isin(*FUNCTIONS)).select("rel_path", F.col("node_id").alias("fn_id"), F.col("label").alias("fn_name"), F.col("role").alias("fn_role"), F.array_contains("flags", "async").alias("fn_async"), F.col("type").alias("fn_type"), F.col("parent_type").alias("fn_parent"), F.col("parent_id").alias("fn_up"))
    wraps = n.where("type = 'CallExpression' and path in ('memo', 'React.memo', 'forwardRef', 'React.forwardRef')").select("rel_path", F.col("node_id").alias("fn_up"), F.lit(True).alias("wrapped"))
    calls = calls.join(owner.join(wraps, ["rel_path", "fn_up"], "left"), ["rel_path", "fn_id"], "left")
    # a branch may be the call itself
    calls = calls.join(around.select("rel_path", "node_id", (F.size("branches") > 0).alias("branched"), (F.size("loops") > 0).alias("looped")), ["rel_path", "node_id"], "left")
    returns = n.where("type = 'ReturnStatement' and fn_id is not null and parent_type <> 'ArrowFunctionExpression'")
    bodies = n.where(F.col("parent_type").isin(*FUNCTIONS) & (F.col("role") == "body")).select("rel_path", F.col("node_id").alias("parent_id"), F.lit(True).alias("top"))
    early = returns.join(bodies, ["rel_path", "parent_id"], "left").where("top is null").groupBy("rel_path", "fn_id").agg(F.min("node_id").alias("return_id"))
    calls = calls.join(early, ["rel_path", "fn_id"], "left")
    hook, name = F.concat(F.lit('React Hook "'), F.col("path"), F.lit('" ')), F.col("fn_name")
    must = "React Hooks must be called in a React function component or a custom React Hook function."
    order = "React Hooks must be called in the exact same order in every component render."
    known = name.rlike(r"^(?:[A-Z]|use[A-Z0-9]|use$)") & ~F.col("fn_type").isin("ClassMethod", "ClassPrivateMethod", "ObjectMethod") | F.coalesce(F.col("wrapped"), F.lit(False))
    anonymous = name.startswith("<")
    use = F.col("path").rlike(r"(?:^|\.)use$")
    said = (
        F.when(F.col("class_id").isNotNull() & F.coalesce(F.col("fn_type").isin("ClassMethod", "ClassPrivateMethod"), F.lit(True)), F.concat(hook, F.lit(f"cannot be called in a class component. {must}"))).when(F.col("fn_id").isNull(), F.concat(hook, F.lit(f"cannot be called at the top level. {must}")))
        .when(known & F.col("fn_async"), F.concat(hook, F.lit("cannot be called in an async function."))).when(known & F.col("looped") & ~use, F.concat(hook, F.lit(f"may be executed more than once. Possibly because it is called in a loop. {order}")))
        .when(known & F.col("branched") & ~use, F.concat(hook, F.lit(f"is called conditionally. {order}"))).when(known & (F.col("return_id") < F.col("node_id")) & ~use, F.concat(hook, F.lit(f"is called conditionally. {order} Did you accidentally call a React Hook after an early return?")))
        .when(~known & (anonymous | (F.col("fn_role") == "argument")), F.concat(hook, F.lit(f"cannot be called inside a callback. {must}")))
        .when(~known, F.concat(hook, F.lit('is called in function "'), name, F.lit('" that is neither a React function component nor a custom React Hook function. React component names must start with an uppercase letter. React Hook names must start with the word "use".')))
    )
    out = calls.withColumn("said", said).where("said is not null")
    return out.select("rel_path", "said", *[F.col(f"c_{c}").alias(c) for c in ("line_start", "col_start", "line_end", "col_end")]), F.col("said")


def _hook_dependencies(n: DataFrame, around: DataFrame) -> tuple[DataFrame, Column]:
    """For each Hook with a callback and a list of dependencies written in place: outer names that the callback reads and the list lacks; if there are none, those that the list need not have.

    An effect may list what it does not read, save for values from outside of the component and what refs hold.
    Elements of the list that are neither names nor member chains nor literals are findings of their own.
    """
    hooks = n.where("type = 'CallExpression'").where(F.col("path").rlike(r"^(?:React\.)?use(?:Effect|LayoutEffect|InsertionEffect|Callback|Memo)$"))
    hooks = hooks.select("rel_path", F.col("node_id").alias("hook"), F.regexp_replace("path", "^React[.]", "").alias("hook_name"), F.col("fn_id").alias("hook_fn"))
    callback = n.where("role = 'argument' and idx = 0 and type in ('FunctionExpression', 'ArrowFunctionExpression')").select("rel_path", F.col("parent_id").alias("hook"), F.col("node_id").alias("cb"), F.col("last_id").alias("cb_last"))
    lists = n.where("role = 'argument' and idx = 1 and type = 'ArrayExpression'").select("rel_path", F.col("parent_id").alias("hook"), F.col("node_id").alias("list"), *[F.col(c) for c in ("line_start", "col_start", "line_end", "col_end")])
    hooks = hooks.join(callback, ["rel_path", "hook"]).join(lists, ["rel_path", "hook"]).where("hook_fn is not null")
    given = n.where("role = 'element' and parent_type = 'ArrayExpression' and path is not null and type in ('Identifier', 'MemberExpression')").select("rel_path", F.col("parent_id").alias("list"), F.col("path").alias("dep"))
    given = given.groupBy("rel_path", "list").agg(F.collect_set("dep").alias("deps"))
    # names that stay the same: setters, dispatchers and refs, and constants with plain values
    calls = n.where("role = 'init' and type = 'CallExpression'").select("rel_path", F.col("parent_id").alias("declarator"), F.regexp_replace("path", "^React[.]", "").alias("made_by"))
    element = n.where("parent_type = 'ArrayPattern' and role = 'element' and idx = 1").select("rel_path", F.col("node_id").alias("binding_id"), F.col("grand_id").alias("declarator")).join(calls.where("made_by in ('useState', 'useReducer', 'useTransition', 'useActionState')"), ["rel_path", "declarator"])
    whole = n.where("parent_type = 'VariableDeclarator' and role = 'id' and type = 'Identifier'").select("rel_path", F.col("node_id").alias("binding_id"), F.col("parent_id").alias("declarator"), F.col("grand_id").alias("declaration"))
    refs = whole.join(calls.where("made_by in ('useRef', 'useEffectEvent')"), ["rel_path", "declarator"])
    const = n.where("type = 'VariableDeclaration' and op = 'const'").select("rel_path", F.col("node_id").alias("declaration"))
    plain = n.where("role = 'init'").where(F.col("type").isin("StringLiteral", "NumericLiteral", "NullLiteral")).select("rel_path", F.col("parent_id").alias("declarator"))
    stable = element.select("rel_path", "binding_id").unionByName(refs.select("rel_path", "binding_id")).unionByName(whole.join(const, ["rel_path", "declaration"], "left_semi").join(plain, ["rel_path", "declarator"], "left_semi").select("rel_path", "binding_id")).distinct()
    bound = n.where("access = 'd'").select("rel_path", F.col("node_id").alias("binding_id"), F.col("fn_id").alias("bound_fn"), F.col("binding_kind").alias("kind"), F.col("role").alias("bound_role"), F.col("parent_id").alias("bound_parent")).where("kind <> 'import'")
    # a function's own name belongs to the function around it
    outer = n.where(F.col("type").isin(*FUNCTIONS)).select("rel_path", F.col("node_id").alias("bound_parent"), F.col("fn_id").alias("outer_fn"))
    bound = bound.join(outer, ["rel_path", "bound_parent"], "left").withColumn("bound_fn", F.when((F.col("kind") == "function") & (F.col("bound_role") == "id"), F.col("outer_fn")).otherwise(F.col("bound_fn")))
    reads = n.where("access in ('r', 'rw') and binding_id is not null").select("rel_path", "node_id", "name", "binding_id", "chain_id")
    used = reads.join(around.select("rel_path", "node_id", F.explode("callbacks").alias("cb")), ["rel_path", "node_id"]).join(hooks.select("rel_path", "hook", "hook_fn", "cb", "cb_last"), ["rel_path", "cb"]).join(bound, ["rel_path", "binding_id"]).where("bound_fn is not null and (bound_fn <= hook_fn) and not (binding_id between cb and cb_last)")
    used = used.join(stable.withColumn("stays", F.lit(True)), ["rel_path", "binding_id"], "left")
    chain = n.select("rel_path", F.col("node_id").alias("chain_id"), F.col("path").alias("chain_path"), F.col("role").alias("chain_role"), F.col("type").alias("chain_type"))
    used = used.join(chain, ["rel_path", "chain_id"], "left")
    dotted = F.coalesce("chain_path", "name")
    need = F.when((F.col("chain_role") == "callee") & dotted.contains("."), F.regexp_replace(dotted, r"\.[^.]*$", "")).otherwise(dotted)
    need = F.regexp_replace(need, r"\.current$", "")
    none = F.array().cast("array<string>")
    needed = used.groupBy("rel_path", "hook").agg(F.collect_set(F.when(F.col("stays").isNull(), need)).alias("needed"), F.collect_set(dotted).alias("touched"))
    # listed names that are bound outside of all functions, imported or not bound at all
    listed_in = n.where("role = 'element' and parent_type = 'ArrayExpression'").select("rel_path", F.col("node_id").alias("chain_id"), F.col("parent_id").alias("list"), F.col("path").alias("dep"))
    outside = n.where("access = 'r'").select("rel_path", "chain_id", "binding_id").join(listed_in, ["rel_path", "chain_id"]).join(bound.select("rel_path", "binding_id", "bound_fn"), ["rel_path", "binding_id"], "left").where("bound_fn is null")
    outside = outside.groupBy("rel_path", "list").agg(F.collect_set("dep").alias("outside"))
    out = hooks.join(needed, ["rel_path", "hook"], "left").join(given, ["rel_path", "list"], "left").join(outside, ["rel_path", "list"], "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("needed", "touched", "deps", "outside")})
    covered = lambda p, among: F.exists(among, lambda d: (p == d) | p.startswith(F.concat(d, F.lit("."))))
    missing = F.filter("needed", lambda p: ~covered(p, F.col("deps")))
    missing = F.array_sort(F.filter(missing, lambda p: ~F.exists(missing, lambda d: p.startswith(F.concat(d, F.lit("."))))))
    current = lambda d: d.endswith(".current")
    free = F.filter("deps", lambda d: ~F.exists("touched", lambda p: (p == d) | p.startswith(F.concat(d, F.lit(".")))) & (~F.col("hook_name").endswith("Effect") | current(d) | F.array_contains("outside", d)))
    out = out.withColumn("missing", missing).withColumn("spare", F.array_sort(free)).where("size(missing) > 0 or size(spare) > 0")
    some = F.when(F.size("missing") > 0, F.col("missing")).otherwise(F.col("spare"))
    quoted, many = F.transform(some, lambda p: F.concat(F.lit("'"), p, F.lit("'"))), F.size(some) > 1
    listed = F.when(many, F.concat(F.array_join(F.slice(quoted, F.lit(1), F.size(quoted) - 1), ", "), F.when(F.size(quoted) > 2, ", and ").otherwise(" and "), F.element_at(quoted, -1))).otherwise(F.get(quoted, F.lit(0)))
    lacks = F.size("missing") > 0
    # Messages.
    what = F.when(lacks, F.when(many, " has missing dependencies: ").otherwise(" has a missing dependency: ")).otherwise(F.when(many, " has unnecessary dependencies: ").otherwise(" has an unnecessary dependency: "))
    held, beyond = F.filter("spare", current), F.filter("spare", lambda d: F.array_contains("outside", d))
    why = F.when(F.size(held) > 0, F.concat(F.lit(" Mutable values like '"), F.get(held, F.lit(0)), F.lit("'"))).when(F.size(beyond) > 0, F.concat(F.lit(" Outer scope values like '"), F.get(beyond, F.lit(0)), F.lit("'")))
    why = F.when(~lacks, F.concat(why, F.lit(" aren't valid dependencies because mutating them doesn't re-render the component.")))
    said = F.concat(F.lit("React Hook "), "hook_name", what, listed, F.lit(". Either "), F.when(lacks, "include ").otherwise("exclude "), F.when(many, "them").otherwise("it"), F.lit(" or remove the dependency array."), F.coalesce(why, F.lit("")))
    place = ["line_start", "col_start", "line_end", "col_end"]
    odd = n.where("role = 'element' and parent_type = 'ArrayExpression' and (path is null or type not in ('Identifier', 'MemberExpression')) and type not in ('Hole', 'SpreadElement')").where(~F.col("type").endswith("Literal"))
    odd = odd.select("rel_path", F.col("parent_id").alias("list"), *place).join(hooks.select("rel_path", "list", "hook_name"), ["rel_path", "list"])
    odd = odd.select("rel_path", *place, F.concat(F.lit("React Hook "), "hook_name", F.lit(" has a complex expression in the dependency array. Extract it to a separate variable so it can be statically checked.")).alias("said"))
    return out.select("rel_path", *place, said.alias("said")).unionByName(odd), F.col("said")


def _unused(n: DataFrame) -> DataFrame:
    """Bindings without a read outside of themselves. Parameters count only after the last one in use; exported names are used."""
    read = n.where("binding_id is not null and access <> 'd'")
    # x++ and x += 1 as statements only write
    real = read.where("access = 'r' or access = 'rw' and grand_type <> 'ExpressionStatement'")
    inside = n.where("type in ('FunctionDeclaration', 'ClassDeclaration')").select("rel_path", F.col("node_id").alias("d_parent"), F.col("last_id").alias("d_last"))
    bound = n.where("access = 'd' and binding_id = node_id and binding_kind not in ('fn-name', 'catch')")
    used = real.select("rel_path", "binding_id", F.col("node_id").alias("use_id")).join(bound.select("rel_path", "binding_id", F.when(F.col("binding_kind").isin("function", "class"), F.col("parent_id")).alias("d_parent")), ["rel_path", "binding_id"])
    used = used.join(inside, ["rel_path", "d_parent"], "left").where("d_last is null or use_id < d_parent or use_id > d_last").select("rel_path", "binding_id").distinct()
    writes = read.where("access in ('w', 'rw')").select("rel_path", "binding_id", F.lit(True).alias("has_write")).distinct()
    tops = n.where("parent_type = 'Program' and type in ('ExportNamedDeclaration', 'ExportDefaultDeclaration')").select("rel_path", F.col("node_id").alias("top_id"), F.lit(True).alias("is_export"))
    out = bound.join(used.withColumn("is_used", F.lit(True)), ["rel_path", "binding_id"], "left").join(writes, ["rel_path", "binding_id"], "left").join(tops, ["rel_path", "top_id"], "left")
    outermost = (F.col("fn_id").isNull() | (F.col("fn_id") == F.col("parent_id")) & F.col("role").isin("id")) & F.col("is_export")
    out = out.withColumn("is_used", F.coalesce("is_used", F.lit(False)) | F.coalesce(outermost & (F.col("depth") <= 5), F.lit(False)))
    # the last parameter in use
    last = F.max(F.when((F.col("binding_kind") == "param") & F.col("is_used"), F.col("node_id"))).over(Window.partitionBy("rel_path", "fn_id"))
    out = out.withColumn("last_used", last)
    out = out.where("not is_used and (binding_kind <> 'param' or last_used is null or node_id > last_used)")
    setters = n.where("type in ('ClassMethod', 'ClassPrivateMethod', 'ObjectMethod') and op = 'set'").select("rel_path", F.col("node_id").alias("fn_id"))
    out = out.join(setters.withColumn("setter", F.lit(True)), ["rel_path", "fn_id"], "left").where("not (coalesce(setter, false) and binding_kind = 'param')")
    inits = n.where("role = 'init' and parent_type = 'VariableDeclarator'").select("rel_path", F.col("parent_id"), F.lit(True).alias("has_init"))
    return out.join(inits, ["rel_path", "parent_id"], "left").withColumn("written", F.coalesce("has_write", "has_init", F.lit(False)))
