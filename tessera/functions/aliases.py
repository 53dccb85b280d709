"""Canonical names of services and owners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: What a service is called, and its one name. The order decides the order of found services.
SERVICES = {
    "checkout-api": "checkout-api",
    "checkout service": "checkout-api",
    "checkout_api": "checkout-api",
    "checkout": "checkout-api",
    "payment-gateway": "payment-gateway",
    "payment gateway": "payment-gateway",
    "payment_gateway": "payment-gateway",
    "payments": "payment-gateway",
    "pgw": "payment-gateway",
    "inventory-service": "inventory-service",
    "inventory service": "inventory-service",
    "inventory_service": "inventory-service",
    "inventory": "inventory-service",
    "fraud-detection": "fraud-detection",
    "fraud detection": "fraud-detection",
    "fraud_detection": "fraud-detection",
    "redis-cache": "redis-cache",
    "redis cache": "redis-cache",
    "redis": "redis-cache",
    "ml-feature-store": "ml-feature-store",
    "ml feature store": "ml-feature-store",
    "feature-store": "ml-feature-store",
    "postgres-primary": "postgres-primary",
    "postgres": "postgres-primary",
}
#: How owners are written, and their one name.
OWNERS = {
    "rahul@company.com": "Rahul Sharma",
    "rahul sharma": "Rahul Sharma",
    "rahul s.": "Rahul Sharma",
    "rahul": "Rahul Sharma",
    "priya@company.com": "Priya Mehta",
    "priya mehta": "Priya Mehta",
    "priya": "Priya Mehta",
    "james@company.com": "James Liu",
    "james liu": "James Liu",
    "james": "James Liu",
}


def _table(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def _key(name: Column) -> Column:
    return strip(F.lower(name))


def resolve_service(name: Column, names: dict[str, str] = SERVICES) -> Column:
    """The canonical service, null for an unknown name."""
    return F.try_element_at(_table(names), _key(name))


def resolve_owner(name: Column, names: dict[str, str] = OWNERS) -> Column:
    """The canonical owner; an unknown name as it is; null for none."""
    return F.when(F.coalesce(name, F.lit("")) != "", F.coalesce(F.try_element_at(_table(names), _key(name)), name))


def services_in(text: Column, names: dict[str, str] = SERVICES) -> Column:
    """Canonical services of which any name occurs in the text, inside words too, in the order of `names`."""
    def found(low: Column) -> Column:
        hits = []
        for service in dict.fromkeys(names.values()):
            own = [alias for alias, of in names.items() if of == service]
            # An alias that holds another one of the service adds nothing.
            least = [a for a in own if not any(b in a for b in own if b != a)]
            hits.append(F.when(reduce(Column.__or__, [low.contains(a) for a in least]), F.lit(service)))
        return F.filter(F.array(*hits), lambda s: s.isNotNull())

    # A one-row array, so that the text is lower-cased once for all aliases.
    return F.get(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), found), F.lit(0))
