"""Parsers: text in, facts out."""

import pytest

from ripplefront.parsers import config, java, patch, patterns, rust

ORDERS = """package com.acme.shop;
import com.acme.core.UserService;
import static com.acme.util.Help.run;
/* class Fake { void no() {} } */
@RestController
@RequestMapping(value = {"/api/orders"}, consumes = "{")
public class Orders extends Base<A, B> implements Api, Gen<String>, x.Other, Second {
  private final UserService users;
  @Autowired OrderRepo repo = new OrderRepo() { void z() { inner(); } };
  List<Foo> foos;
  Orders(UserService u) { this.users = u; u.init(); }
  @GetMapping(path = "/{id}/items")
  public <T> Map<String, T> get(String id) throws X {
    // users.fake();
    Local local = new Local();
    for (Item it : xs) { it.go(); }
    users.find(id).then(x -> run.me());
    this.own(); repo.save("a.b()"); local.work(); other(); a.b.c(); foos.add(1);
    kafka.send("topic-a", id); jdbc.q("SELECT a, b FROM users WHERE x");
    redis.opsForValue().get("user:*"); redis.delete("k1");
    return z > foo(1) ? null : Collections.<T>emptyMap();
  }
  @KafkaListener(topics = "t-in") void on(String m) {}
  static class Inner { void deep() { users.x(); } }
  interface Remote { @PostMapping("/x") String post(String b); }
}
"""


def facts(text=ORDERS, app=java.App("shop", "/ctx")):
    return java.parse(text, "Orders.java", app)


def by_name(found):
    return {m["fqn"]: m for m in found["methods"]}


def test_java_classes():
    classes = {c["name"]: c for c in facts()["classes"]}
    assert set(classes) == {f"com.acme.shop.{n}" for n in ("Orders", "Inner", "Remote")}
    assert classes["com.acme.shop.Orders"]["implements"] == ["com.acme.shop.Api", "com.acme.shop.Second"]
    assert classes["com.acme.shop.Orders"]["line_start"] == 5
    assert classes["com.acme.shop.Remote"]["is_interface"]


def test_java_methods_are_no_constructors_nor_anonymous():
    assert set(by_name(facts())) == {
        "com.acme.shop.Orders::get", "com.acme.shop.Orders::on", "com.acme.shop.Inner::deep", "com.acme.shop.Remote::post",
    }


def test_java_calls():
    calls = [c["target"] for c in by_name(facts())["com.acme.shop.Orders::get"]["calls"]]
    assert calls == [
        "go", "com.acme.core.UserService::find", "then", "com.acme.util.Help.run::me", "own", "com.acme.shop.OrderRepo::save",
        "com.acme.shop.Local::work", "other", "c", "com.acme.shop.List<Foo>::add", "send", "q", "opsForValue", "get", "delete", "foo", "emptyMap",
    ]


def test_java_fields_are_those_of_the_nearest_class():
    assert [c["target"] for c in by_name(facts())["com.acme.shop.Inner::deep"]["calls"]] == ["x"]


def test_java_endpoint_and_operations():
    m = by_name(facts())["com.acme.shop.Orders::get"]
    assert m["http"] == {"method": "GET", "path": "shop/ctx/api/orders/{id}/items", "path_params": ["id"], "is_feign_client": False}
    assert [(k["op"], k["topic"]) for k in m["kafka"]] == [("Produce", "topic-a")]
    assert [(k["op"], k["table"]) for k in m["db"]] == [("Select", "users")]
    assert [(k["op"], k["key_pattern"]) for k in m["redis"]] == [("Get", "user:*"), ("Delete", "k1")]
    assert by_name(facts())["com.acme.shop.Orders::on"]["kafka"] == [{"op": "Consume", "topic": "t-in", "line": 23}]


@pytest.mark.parametrize(
    "app, path",
    [
        (java.App("svc", "/ctx"), "svc/ctx/api/orders/{id}/items"),
        (java.App("svc", ""), "svc/api/orders/{id}/items"),
        (java.App(), "api/orders/{id}/items"),
        (java.App("svc/", "ctx/"), "svc/ctx/api/orders/{id}/items"),
    ],
)
def test_provider_path(app, path):
    assert by_name(facts(app=app))["com.acme.shop.Orders::get"]["http"]["path"] == path.replace("api/orders/", "api/orders/", 1)


@pytest.mark.parametrize(
    "client, mapping, path, method",
    [
        ('value = "user-svc", path = "/base"', '@PostMapping("/copy/info")', "user-svc/base/copy/info", "POST"),
        ('value = "user-svc"', '@GetMapping("/api/users")', "user-svc/api/users", "GET"),
        ('name = "order-svc", path = "orders"', '@RequestMapping(method = RequestMethod.PUT, value = "/update")', "order-svc/orders/update", "PUT"),
    ],
)
def test_feign_path(client, mapping, path, method):
    text = f"package a.b;\n@FeignClient({client})\ninterface C {{ {mapping} void m(); }}"
    (m,) = java.parse(text, "C.java", java.App("own", "/x"))["methods"]
    assert m["http"] == {"method": method, "path": path, "path_params": [], "is_feign_client": True}


def test_positional_feign_is_a_provider():
    (m,) = java.parse('package a.b; @FeignClient("x") interface C { @GetMapping("/y") void m(); }', "C.java")["methods"]
    assert not m["http"]["is_feign_client"]


def test_mapping_without_literal_has_no_endpoint():
    (m,) = java.parse("package a.b; class C { @GetMapping void m() {} }", "C.java")["methods"]
    assert m["http"] is None


@pytest.mark.parametrize("text", ["", "not java {{{ (((", "class", "class A {", 'class A { void b( { "unclosed', "@" * 50, "import ;;;"])
def test_broken_java_is_no_error(text):
    assert java.parse(text, "A.java")["language"] == "java"


def test_single_segment_package_is_none():
    assert java.parse("package a; class B {}", "B.java")["classes"][0]["name"] == "B"


RUST = r'''use std::{io, fs};
use a::b::C;
mod user {
    pub mod inner {
        #[inline]
        pub async fn create_user(x: &'a str) -> Result<(), E> {
            println!("a {}", hidden(x)); /* nested /* fn no() {} */ */
            let Some(v) = get(x)? else { return };
            match v { Ok(q) => go::<u8>(q), Err(e) if bad(e) => self.fail(e).await, _ => {} }
            let c = 'x'; let r = r#"fn no() {}"#;
            Vec::<u8>::new().push(1);
            sqlx::query("INSERT INTO users VALUES (1)").execute(&p).await
        }
    }
}
impl A {
    fn b(&self) {
        Router::new().route("/u/:id", get(h));
        producer.send("ev"); redis.get("k:1"); consumer.subscribe(&["t1"]); let s: StreamConsumer = x;
    }
}
trait T { fn only_declared(&self); }
'''


def test_rust_functions():
    found = by_name(rust.parse(RUST, "a.rs"))
    assert set(found) == {"user::inner::create_user", "b"}
    m = found["user::inner::create_user"]
    assert (m["line_start"], m["line_end"]) == (6, 13)
    assert [c["target"] for c in m["calls"]] == [
        "println!", "get", "go::<u8>", "bad", "self.fail", "Vec::<u8>::new", "Vec::<u8>::new().push", "sqlx::query",
        'sqlx::query("INSERT INTO users VALUES (1)").execute',
    ]
    assert [(x["op"], x["table"]) for x in m["db"]] == [("Insert", "users")]


def test_rust_route_kafka_redis():
    m = by_name(rust.parse(RUST, "a.rs"))["b"]
    assert m["http"] == {"method": "GET", "path": "/u/:id", "path_params": ["id"], "is_feign_client": False}
    assert [(k["op"], k["topic"]) for k in m["kafka"]] == [("Produce", "ev"), ("Consume", "t1")]
    assert [(k["op"], k["key_pattern"]) for k in m["redis"]] == [("Get", "k:1")]


def test_rust_uses():
    assert rust.parse(RUST, "a.rs")["imports"][:2] == [{"module": "std", "items": ["io", "fs"]}, {"module": "a::b::C", "items": []}]


def test_rust_redis_needs_the_word():
    (m,) = rust.parse('fn f() { cache.get("k"); }', "a.rs")["methods"]
    assert m["redis"] == []


PATCH = """diff --git a/src/A.java b/src/A.java
--- a/src/A.java
+++ b/src/A.java
@@ -1,3 +1,4 @@ class A
 a
-b
+c
+d
 e
@@ -9 +10 @@
-x
+y
\\ No newline at end of file
diff --git a/New.rs b/New.rs
--- /dev/null
+++ b/New.rs
@@ -0,0 +1,2 @@
+fn x() {}
+
diff --git a/Gone.rs b/Gone.rs
--- a/Gone.rs
+++ /dev/null
@@ -1 +0,0 @@
--- a removed comment
"""


def test_patch_files_and_hunks():
    found = patch.parse(PATCH + "-- \n2.40.1\n")
    assert [(f["file_path"], f["change_type"]) for f in found] == [("src/A.java", "Modified"), ("New.rs", "Added"), ("Gone.rs", "Deleted")]
    first, second = found[0]["hunks"]
    assert (first["old_start"], first["old_lines"], first["new_start"], first["new_lines"]) == (1, 3, 1, 4)
    assert [x["line_type"] for x in first["lines"]] == ["Context", "Removed", "Added", "Added", "Context"]
    assert (second["old_lines"], second["new_lines"]) == (1, 1)
    assert found[2]["hunks"][0]["lines"] == [{"line_type": "Removed", "content": "-- a removed comment"}]


def test_patch_trailer_rule():
    assert patch.without_trailer("a\n-- \n2.1\n") == "a\n-- \n"
    assert patch.without_trailer("a\n-- \n\nb\n") == "a\n-- \n\nb\n"
    assert [f["file_path"] for f in patch.parse(PATCH, compat=True)] == ["src/A.java", "New.rs", "Gone.rs"]


def test_patch_that_is_none():
    with pytest.raises(patch.PatchError):
        patch.parse("hello\nworld\n")
    assert patch.parse("") == []


def test_binary_patch_is_left_out():
    assert patch.parse("diff --git a/x.png b/x.png\nBinary files a/x.png and b/x.png differ\n") == []


def test_xml():
    text = "<c><api-url> https://h/api/v1/users/{id}?q=1 </api-url><topic/><n>not a topic</n><kafka-topic>t1</kafka-topic><table>u</table><x><key>user:*</key></x></c>"
    assert config.parse_xml(text) == [("http", "GET", "/api/v1/users/{id}"), ("kafka", None, "t1"), ("db", None, "u"), ("redis", None, "user:*")]


def test_xml_announcements_wait_for_a_text():
    assert config.parse_xml("<c><topic><inner>t</inner></topic></c>") == [("kafka", None, "t")]
    assert config.parse_xml("<c><topic></topic><any>t</any></c>") == [("kafka", None, "t")]
    assert config.parse_xml("<c><topic><![CDATA[t]]></topic></c>") == []
    assert config.parse_xml("<c><table>t</table><table>t</table></c>") == [("db", None, "t")]


def test_bad_configuration():
    with pytest.raises(config.ConfigError):
        config.parse_xml("<a><b></a>")
    with pytest.raises(config.ConfigError):
        config.parse_yaml("a: [1, 2")


def test_yaml():
    text = "svc:\n  service-url: http://x/y?z\n  url-list: ['/no']\n  topics: [a, b, a, 3]\n  kafka: {servers: h}\n  tableName: users\n  cache-key: 'u:*'\n  endpoint: plain\n"
    assert config.parse_yaml(text) == [("http", "GET", "/y"), ("kafka", None, "a"), ("kafka", None, "b"), ("db", None, "users"), ("redis", None, "u:*")]


def test_application():
    assert config.application("spring: {application: {name: svc}}\nserver: {servlet: {context-path: /c}}\n") == ("svc", "/c")
    assert config.application("a: 1") == (None, "")


def test_joined_path():
    assert patterns.joined_path("/a/", "/b", "", None, "//c") == "a/b/c"
    assert patterns.joined_path("a", "/") == "a"
