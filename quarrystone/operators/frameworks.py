"""Methods that a Java framework calls from outside, by annotations, supertypes and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EE = ("javax", "jakarta")  # Java EE packages have two roots


def _ee(*names: str) -> tuple[str, ...]:
    return tuple(f"{root}.{n}" for root in _EE for n in names)


def _in(package: str, *names: str) -> tuple[str, ...]:
    return tuple(f"{package}.{n}" for n in names)


#: Names of annotations and types by which frameworks mark what they call (fixed values).
SPRING_CONTROLLERS = ("org.springframework.stereotype.Controller", "org.springframework.web.bind.annotation.RestController")
SPRING_MAPPINGS = _in("org.springframework.web.bind.annotation", "RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping")
PATH = _ee("ws.rs.Path")
HTTP_METHODS = _ee(*_in("ws.rs", "GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD"))
HTTP_META = _ee("ws.rs.HttpMethod")
MICRONAUT_CONTROLLERS = ("io.micronaut.http.annotation.Controller",)
MICRONAUT_MAPPINGS = _in("io.micronaut.http.annotation", "Get", "Post", "Put", "Delete", "Patch", "Options", "Head", "Trace")
QUARKUS_ROUTES = _in("io.quarkus.vertx.web", "Route", "RouteFilter")
HTTP_SERVLETS = _ee("servlet.http.HttpServlet")
SERVLET_METHODS = ("service", "doGet", "doPost", "doPut", "doDelete", "doPatch", "doHead", "doOptions", "doTrace")
FILTERS, SERVLETS = _ee("servlet.Filter"), _ee("servlet.Servlet")
WEBSOCKETS = _ee("websocket.server.ServerEndpoint")
WEBSOCKET_EVENTS = _ee(*_in("websocket", "OnOpen", "OnClose", "OnMessage", "OnError"))
GRPC_SERVICES, GRPC_OBSERVER = ("io.grpc.BindableService",), "io.grpc.stub.StreamObserver"
DUBBO = _in("org.apache.dubbo.config.annotation", "DubboService", "Service")
SPRING_CALLBACKS = (
    *_ee("annotation.PostConstruct"), "org.springframework.scheduling.annotation.Scheduled", "org.springframework.context.event.EventListener",
    "org.springframework.kafka.annotation.KafkaListener", "org.springframework.amqp.rabbit.annotation.RabbitListener", "org.springframework.jms.annotation.JmsListener",
    *_in("org.springframework.messaging", "handler.annotation.MessageMapping", "simp.annotation.SubscribeMapping"),
)
RUNNERS = _in("org.springframework.boot", "CommandLineRunner", "ApplicationRunner")
LISTENERS = ("org.springframework.context.ApplicationListener",)

_ABOVE = (*HTTP_SERVLETS, *FILTERS, *SERVLETS, *GRPC_SERVICES, *RUNNERS, *LISTENERS)


def framework_entry_points(methods: DataFrame, above: DataFrame) -> DataFrame:
    """(method, framework): a row for each framework that calls a method, `spring_ioc` being callbacks rather than requests.

    methods: (method, cls, name, n_params, annotations, meta, cls_annotations, public, static, types, overrides): `meta` are the annotations of its
    annotations, `types` those of its parameters and result, `overrides` tells whether it overrides or implements another; arrays may be null.
    above: (node, ancestor) of classes, the closure of their supertypes.
    """
    wanted = above.where(F.col("ancestor").isin(*_ABOVE)).groupBy(F.col("node").alias("cls")).agg(F.collect_set("ancestor").alias("_up"))  # a few of each class
    m = methods.join(wanted, "cls", "left")
    has = lambda c, names: F.coalesce(F.arrays_overlap(F.array_compact(c), F.array(*map(F.lit, names))), F.lit(False))
    on, cls, up = (lambda names, c=c: has(c, names) for c in ("annotations", "cls_annotations", "_up"))
    named: Column = F.col("name")
    open_ = F.col("public") & ~F.col("static") & (named != "<init>")
    rules = {
        "spring": cls(SPRING_CONTROLLERS) & on(SPRING_MAPPINGS),
        "jaxrs": on(PATH) | (cls(PATH) & (on(HTTP_METHODS) | has("meta", HTTP_META))),
        "micronaut": cls(MICRONAUT_CONTROLLERS) & on(MICRONAUT_MAPPINGS),
        "quarkus": on(QUARKUS_ROUTES),
        "servlet": (named.isin(*SERVLET_METHODS) & up(HTTP_SERVLETS)) | ((named == "doFilter") & (F.col("n_params") == 3) & up(FILTERS)) | ((named == "service") & up(SERVLETS)),
        "websocket": cls(WEBSOCKETS) & on(WEBSOCKET_EVENTS),
        "grpc": up(GRPC_SERVICES) & open_ & (named != "bindService") & has("types", [GRPC_OBSERVER]),
        "dubbo": cls(DUBBO) & open_ & ((named == "$invoke") | F.col("overrides")),
        "main": (named == "main") & F.col("public") & F.col("static") & (F.col("n_params") <= 1),
        "spring_ioc": on(SPRING_CALLBACKS) | ((named == "run") & up(RUNNERS)) | ((named == "onApplicationEvent") & up(LISTENERS)),
    }
    hits = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return m.select("method", F.explode(hits).alias("framework"))
