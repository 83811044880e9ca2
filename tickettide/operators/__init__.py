"""DataFrame operators. They build plans only: no session, no collect, no clock."""
