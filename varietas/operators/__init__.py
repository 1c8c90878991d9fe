"""DataFrame → DataFrame operators (A*, J*, W*, U*, F*, L*)."""
