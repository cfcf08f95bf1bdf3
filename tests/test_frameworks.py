"""Entry points of each framework, and methods that are none."""

from quarrystone.operators.frameworks import framework_entry_points

SCHEMA = "method string, cls string, name string, n_params int, annotations array<string>, meta array<string>, cls_annotations array<string>, public boolean, static boolean, types array<string>, overrides boolean"


def test_frameworks(spark):
    web, rs = "org.springframework.web.bind.annotation.", "jakarta.ws.rs."
    row = lambda method, cls="C", name="x", n=0, on=None, meta=None, over=None, public=True, static=False, types=None, overrides=False: (method, cls, name, n, on, meta, over, public, static, types, overrides)
    cases = [
        (row("spring", on=[web + "GetMapping"], over=[web + "RestController"]), {"spring"}), (row("no class", on=[web + "GetMapping"]), set()), (row("no mapping", over=[web + "RestController"]), set()),
        (row("rs", on=[rs + "GET"], over=[rs + "Path"]), {"jaxrs"}), (row("rs method only", on=[rs + "GET"]), set()), (row("locator", on=["javax.ws.rs.Path"]), {"jaxrs"}), (row("rs meta", meta=[rs + "HttpMethod"], over=[rs + "Path"]), {"jaxrs"}),
        (row("micronaut", on=["io.micronaut.http.annotation.Trace"], over=["io.micronaut.http.annotation.Controller"]), {"micronaut"}), (row("quarkus", on=["io.quarkus.vertx.web.Route", None]), {"quarkus"}),
        (row("servlet", "Page", "doPost"), {"servlet"}), (row("filter", "Gate", "doFilter", 3), {"servlet"}), (row("filter of two", "Gate", "doFilter", 2), set()), (row("service", "Raw", "service"), {"servlet"}), (row("other", "Raw", "doGet"), set()),
        (row("socket", on=["javax.websocket.OnOpen"], over=["javax.websocket.server.ServerEndpoint"]), {"websocket"}),
        (row("grpc", "Rpc", "call", 2, types=["Req", "io.grpc.stub.StreamObserver"]), {"grpc"}), (row("bind", "Rpc", "bindService", types=["io.grpc.stub.StreamObserver"]), set()), (row("private grpc", "Rpc", "call", public=False, types=["io.grpc.stub.StreamObserver"]), set()),
        (row("dubbo", over=["org.apache.dubbo.config.annotation.DubboService"], overrides=True), {"dubbo"}), (row("own dubbo", over=["org.apache.dubbo.config.annotation.Service"]), set()), (row("invoke", name="$invoke", over=["org.apache.dubbo.config.annotation.Service"]), {"dubbo"}),
        (row("main", name="main", n=1, static=True), {"main"}), (row("main of two", name="main", n=2, static=True), set()), (row("instance main", name="main"), set()),
        (row("ioc", on=["jakarta.annotation.PostConstruct"]), {"spring_ioc"}), (row("runner", "Boot", "run"), {"spring_ioc"}), (row("both", "Page", "service", on=["javax.ws.rs.Path"]), {"servlet", "jaxrs"}),
    ]
    above = [("Page", "javax.servlet.http.HttpServlet"), ("Page", "javax.servlet.Servlet"), ("Gate", "jakarta.servlet.Filter"), ("Raw", "javax.servlet.Servlet"), ("Rpc", "io.grpc.BindableService"), ("Boot", "org.springframework.boot.CommandLineRunner"), ("C", "java.lang.Object")]
    out = framework_entry_points(spark.createDataFrame([r for r, _ in cases], SCHEMA), spark.createDataFrame(above, "node string, ancestor string")).collect()
    got = {}
    for r in out:
        got.setdefault(r.method, set()).add(r.framework)
    assert got == {r[0]: want for r, want in cases if want}
    assert len(out) == sum(len(w) for _, w in cases)
