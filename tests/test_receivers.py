"""Calls by the declared types of their receivers, generated clients and declared HTTP clients."""

import json

from latticework.sources import extract, receivers
from tests.conftest import rows

ORDERS = """
public class Orders {
  private final OrderRepository orders;
  private JdbcTemplate jdbc;
  @Autowired
  private MongoTemplate mongo;
  @PersistenceContext
  private EntityManager manager;
  private Other other;
  private PricesClient prices;
  private ShippingGrpc.ShippingBlockingStub shipping;

  public void run() {
    orders.save(null); orders.findById(1); orders.findByName("x"); orders.deleteByName("x"); orders.purge(); orders.odd();
    jdbc.queryForList("x"); jdbc.update("x"); mongo.findAndModify(null); mongo.find(null);
    manager.persist(null); this.manager.find(null); other.save(null); unknown.save(null);
    prices.price("1"); shipping.ship(null);
  }
}
"""
REPOSITORY = """
public interface OrderRepository extends JpaRepository<Order, Long> {
  @Query("delete from Order") @Modifying
  void purge();
  @Query(value = "select (1)")
  List<Order> odd();
}
@FeignClient(name = "pricing", path = "/x")
@RequestMapping("/v1")
public interface PricesClient {
  @GetMapping("/prices/{id}") Price price(String id);
}
class Order { @NotNull private String name; private Integer n; }
"""
SERVER = """
@GrpcService
public class ShippingService extends ShippingGrpc.ShippingImplBase {
  @Override public void ship(Request r, StreamObserver<Reply> o) { o.onNext(null); }
  public void helper() { }
}
"""
GO = """
package a
type server struct {
	pb.UnimplementedShippingServer
	mail pb.MailClient
}
type Item struct {
	Name string `json:"name" validate:"required"`
	Size *int
}
func New() *server { return &server{mail: pb.NewMailClient(c)} }
func (s *server) Ship(ctx context.Context) error { s.mail.Send(ctx); return nil }
func load(db *gorm.DB, q *sql.DB) { db.Find(x); db.Create(x); q.QueryRow("x"); q.Exec("x"); other.Find(x) }
"""
NODE = """
const User = mongoose.model('User', schema);
const prisma = new PrismaClient();
function handle() { User.findOne({}); User.updateOne({}); prisma.user.findMany(); prisma.user.create({}); prisma.create({}); Car.findOne({}); }
"""


def test_calls_by_declared_receivers(spark):
    files = [("Orders.java", ORDERS), ("OrderRepository.java", REPOSITORY), ("ShippingService.java", SERVER), ("a.go", GO), ("b.js", NODE), ("empty.go", None), ("c.txt", "x")]
    df = spark.createDataFrame(files, "path string, text string")
    d = receivers.declared(df).cache()
    e = extract.facts_of(extract.extract(df), "flow_edge", "from_symbol", "to_symbol", "edge_kind").withColumnRenamed("edge_kind", "kind")
    marked = receivers.classified(e.drop("kind").selectExpr("*", "'invokes' AS kind"), d)
    kinds = {(s, t): k for s, t, k in rows(marked, "from_symbol", "to_symbol", "kind")}
    run = {t: k for (s, t), k in kinds.items() if s == "Orders.run"}
    assert run == {
        "orders.save": "writes", "orders.findById": "reads", "orders.findByName": "reads", "orders.deleteByName": "writes", "orders.purge": "writes", "orders.odd": "reads", "jdbc.queryForList": "reads", "jdbc.update": "writes", "mongo.findAndModify": "writes",
        "mongo.find": "reads", "manager.persist": "writes", "this.manager.find": "reads", "other.save": "invokes", "unknown.save": "invokes", "prices.price": "invokes", "shipping.ship": "invokes",
    }
    assert {t: k for (s, t), k in kinds.items() if s == "load"} == {"db.Find": "reads", "db.Create": "writes", "q.QueryRow": "reads", "q.Exec": "writes", "other.Find": "invokes"}
    assert {t: k for (s, t), k in kinds.items() if s == "handle"} == {"User.findOne": "reads", "User.updateOne": "writes", "prisma.user.findMany": "reads", "prisma.user.create": "writes", "prisma.create": "invokes", "Car.findOne": "invokes"}
    assert rows(receivers.remote_calls(e, d), "source", "target_service", "target_method", "target_path") == [("Orders.run", "pricing", "GET", "/v1/prices/{id}")]
    rpcs = spark.createDataFrame([("Shipping", "Ship"), ("Mail", "Send")], "service string, method string")
    assert rows(receivers.grpc_entrypoints(d, rpcs), "symbol", "name") == [("ShippingService.ship", "Shipping/Ship"), ("server.Ship", "Shipping/Ship")]
    assert rows(receivers.grpc_calls(e, d, rpcs), "source", "name") == [("Orders.run", "Shipping/Ship"), ("server.Ship", "Mail/Send")]
    contracts = spark.createDataFrame([("Order",), ("Item",), ("None",)], "type string")
    shapes = {t: json.loads(s) if s else None for t, s in rows(receivers.with_shapes(contracts, d, "type"), "type", "shape")}
    assert shapes["None"] is None and [(f["name"], f["required"]) for f in shapes["Order"]] == [("name", True), ("n", False)]
    assert [(f["name"], f["type"], f["required"]) for f in shapes["Item"]] == [("name", "string", True), ("Size", "int", False)]
